"""Semantics of versions, as-of reads, fingerprints and paging."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tempolith.functions import codec, keys, scalars
from tempolith.operators import asof, kv, ledger
from tempolith.schema import LEDGER_SCHEMA


def book(spark, *rows):
    """(key, seq, write_nanos, payload[, source[, schema_ver[, hash]]])"""
    full = []
    for r in rows:
        key, seq, nanos, payload, source, ver, digest = (*r, *("", 0, "")[len(r) - 4 :])
        full.append((key, seq, nanos, source, ver, digest, payload.encode()))
    return spark.createDataFrame(full, LEDGER_SCHEMA)


def test_latest_and_as_of(spark):
    b = book(spark, ("k", 1, 100, "a"), ("k", 3, 300, "c"), ("k", 2, 200, "b"))
    assert ledger.latest(b).first().seq == 3
    assert ledger.as_of(b, 200).first().payload == b"b"
    assert ledger.as_of(b, 50).count() == 0


def test_as_of_takes_the_greatest_seq_not_the_latest_time(spark):
    b = book(spark, ("k", 1, 100, "1"), ("k", 2, 300, "2"), ("k", 3, 200, "3"))
    assert ledger.as_of(b, 250).first().seq == 3 and ledger.as_of(b, 150).first().seq == 1
    tie = book(spark, ("k", 1, 100, "v1"), ("k", 2, 100, "v2"))
    assert ledger.as_of(tie, 100).first().seq == 2


def test_fingerprint(spark):
    a = ledger.fingerprint(book(spark, ("b", 1, 0, "x"), ("a", 2, 0, "y"))).first()
    b = ledger.fingerprint(book(spark, ("a", 2, 0, "y"), ("b", 1, 0, "x")))
    assert a == b.first() and a.fingerprint == hashlib.sha256(b"a|2|1|y\nb|1|1|x\n").hexdigest()
    assert ledger.fingerprint(book(spark, ("a", 1, 0, "bc"))).first() != ledger.fingerprint(book(spark, ("ab", 1, 0, "c"))).first()
    assert ledger.fingerprint_streamed(book(spark, ("b", 1, 0, "x"), ("a", 2, 0, "y"))) == (2, a.fingerprint)
    assert ledger.fingerprint(book(spark, ("a", 1, 0, "x")).limit(0)).first().fingerprint == hashlib.sha256(b"").hexdigest()


def test_audit_filters(spark):
    b = book(spark, ("q:1", 1, 100, "1", "job-a", 1), ("q:1", 2, 200, "2", "job-b", 1), ("q:1", 3, 300, "3", "job-a", 2))
    assert [r.seq for r in ledger.list_writes(b, "q:1", 150, 250).collect()] == [2]
    assert [r.seq for r in ledger.list_writes(b, "q:1", source="job-a").collect()] == [1, 3]
    assert {r.source: r.writes for r in ledger.writes_by_source(b).collect()} == {"job-a": 2, "job-b": 1}
    assert all(r.hash_ok for r in ledger.list_writes(b).collect())  # no persisted hash


def test_paging_skips_nothing(spark):
    b = book(spark, *[(k, s, s * 100, "x") for s in (1, 2) for k in ("order:1", "order:10")])
    pages = [[(r.logical_key, r.seq) for r in p] for p in ledger.pages(b, 1)]
    assert pages == [[("order:1", 1)], [("order:1", 2)], [("order:10", 1)], [("order:10", 2)]]
    assert ledger.list_writes_page(b, 0, ("order:1", 1)).count() == 3


def test_replay_finds_drift(spark):
    b = book(spark, ("k:1", 1, 100, "a"), ("k:2", 1, 100, "b"))
    p = ledger.current_pointers(b)
    assert ledger.replay(b, p).first().mismatches == []
    spoilt = p.withColumn("payload_hash", F.when(F.col("logical_key") == "k:2", "00").otherwise(F.col("payload_hash")))
    assert ledger.replay(b, spoilt).first().mismatches == ["k:2"]
    bounded = ledger.replay(b, spoilt, as_of_nanos=50).first()
    assert bounded.bounded and bounded.mismatches == [] and bounded.key_count == 2
    assert ledger.mismatches(p.union(spark.createDataFrame([("gone", 1, "x")], p.schema)), b).first().reason == "orphan"


def test_append_continues_seqs(spark, tmp_path):
    rows = lambda *payloads: spark.createDataFrame([("q:a", p.encode(), "s", 1, 5, i) for i, p in enumerate(payloads)], "logical_key string, payload binary, source string, schema_ver int, write_nanos bigint, arrival int")
    path = str(tmp_path / "t")
    ledger.append(rows("1", "2"), path)
    ledger.append(rows("3"), path)
    got = spark.read.parquet(path).orderBy("seq").collect()
    assert [(r.seq, bytes(r.payload)) for r in got] == [(1, b"1"), (2, b"2"), (3, b"3")]
    assert all(r.persisted_hash == hashlib.sha256(bytes(r.payload)).hexdigest() and r.kind == "q" for r in got)


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(4)}", i, rng.randrange(100), f"p{i}") for i in range(60)]
    probes = [(i, f"k{rng.randrange(5)}", rng.randrange(110)) for i in range(80)]
    b = book(spark, *rows)
    got = {r.probe: r.seq for r in asof.asof_join(spark.createDataFrame(probes, "probe int, logical_key string, at bigint"), b).collect()}
    want = {p: max((s for k, s, n, _ in rows if k == key and n <= at), default=None) for p, key, at in probes}
    assert got == want
    spans = asof.visibility(b).collect()
    for p, key, at in probes:
        hit = [r.seq for r in spans if r.logical_key == key and r.from_nanos <= at and (r.to_nanos is None or at < r.to_nanos)]
        assert hit == ([want[p]] if want[p] is not None else [])


def test_kv_newest_wins(spark):
    changes = spark.createDataFrame([("a", "1", "P", 1), ("a", None, "D", 2), ("b", "", "P", 1), ("c", "x", "P", 1), ("c", "y", "P", 2)], "key string, value string, op string, arrival int")
    assert {r.key: r.value for r in kv.current(changes).collect()} == {"b": "", "c": "y"}
    merged = kv.merge(changes.where("arrival = 1"), changes.where("arrival = 2"))
    assert {r.key: r.op for r in merged.collect()} == {"a": "D", "b": "P", "c": "P"}


def test_transparent_get_outlives_delete(spark):
    b = book(spark, ("k", 1, 1, "old"), ("k", 2, 2, "new"))
    own = spark.createDataFrame([("p", "plain")], "key string, value string")
    assert {r.key: r.value for r in kv.get_transparent(own, b).collect()} == {"p": "plain", "k": "new"}


def test_record_codec(spark):
    raw = codec.encode_record(100, "job", 2, "ab", b"pl")
    assert raw.hex() == "0100000000000080" "6400000000000000" "03000000" "6a6f62" "02000000" "0200" "6162" "706c"
    assert codec.decode_record(raw) == (100, "job", 2, "ab", b"pl")
    assert codec.decode_record((7).to_bytes(8, "little") + b"x") == (7, "", 0, "", b"x")
    assert codec.decode_record(raw[:12]) is None and codec.decode_record(b"") is None


def test_pointer_codec(spark):
    from tempolith.functions import codec
    from tempolith.sources import tables

    raw = codec.encode_pointer(7, "ab" * 32)
    assert raw[:10] == bytes([7, 0, 0, 0, 0, 0, 0, 0, 64, 0]) and codec.decode_pointer(raw) == (7, "ab" * 32)
    assert codec.decode_pointer(raw[:-1]) is None and codec.decode_pointer(b"") is None and codec.decode_pointer(None) is None
    dump = spark.createDataFrame([("k:current", raw), ("cut:current", raw[:20]), ("k", b"x")], "key string, value binary")
    assert [tuple(r) for r in tables.import_pointers(dump).collect()] == [("k", 7, "ab" * 32)]


def test_fingerprint_is_linear(spark):
    import time

    rows = spark.range(60_000).select(F.format_string("k%08d", "id").alias("logical_key"), F.lit(1).cast("long").alias("seq"), F.repeat(F.lit("x"), 150).cast("binary").alias("payload"))
    began = time.time()
    assert ledger.fingerprint(rows).first().key_count == 60_000 and time.time() - began < 30


def test_key_functions(spark):
    df = spark.createDataFrame([("order:1:v00000000000000000007",), ("order:1:current",), ("a:v1",), ("imu:dev0:100",), ("x:-5",)], "k string")
    got = df.select(keys.parse_version_key("k").alias("p"), keys.is_internal("k").alias("i"), *[c.alias(n) for c, n in zip(keys.device_and_ts("k"), "dt")]).collect()
    assert got[0].p.logical_key == "order:1" and int(got[0].p.seq) == 7 and [r.i for r in got] == [True, True, False, False, False]
    assert (got[3].d, got[3].t, got[4].d, got[4].t) == ("imu:dev0", 100, "x", -5) and got[2].t is None


def test_slots_and_schedules(spark):
    one = spark.createDataFrame([(-1,), (0,), (86_400 * 10**9 - 1,), (86_400 * 10**9,)], "n bigint")
    assert [r[0] for r in one.select(scalars.slot(F.col("n"), 86400)).collect()] == [0, 0, 0, 1]
    assert [r[0] for r in one.select(scalars.floor_div(F.col("n"), 10)).collect()][0] == -1
    assert scalars.parse_schedule("daily@16:10 Asia/Shanghai") == (16, 10, "Asia/Shanghai")
    for bad in ("daily@24:00 UTC", "weekly@1:00 UTC", "daily@1:60 UTC"):
        with pytest.raises(ValueError):
            scalars.parse_schedule(bad)


def test_prefix_is_that_of_the_storage_key(spark):
    b = book(spark, *[(k, s, 1, "x") for k in ("order:1001", "order:1001:a", "order:10012", "a:v1") for s in (1, 2)])
    for tail, key in ((":v", keys.version_key("logical_key", "seq")), (":current", keys.current_key("logical_key"))):
        for prefix in ("", "o", "order:1001", "order:1001:", "order:1001:v", "order:1001:v0000000000000000000", "order:1001:v00000000000000000001", "order:1001:curr", "order:1001:x", "a:v", "a:v1:"):
            want = b.where(key.startswith(prefix)).count()
            assert b.where(ledger.under_prefix(prefix, tail)).count() == want, (tail, prefix)
