"""Reads and writes of the versioned ledger."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.scalars import hash_ok, payload_hash
from ..schema import LEDGER_SCHEMA

#: Kinds of one append that a filter on partitions lists.
MOST_KINDS = 1_000
_BODY = ["seq", "write_nanos", "source", "schema_ver", "persisted_hash", "payload"]


def time_window(t_from: int = 0, t_to: int = 0) -> Column:
    """Both ends included; an end of 0 or less is open."""
    test = F.lit(True)
    if t_from > 0:
        test = test & (F.col("write_nanos") >= t_from)
    if t_to > 0:
        test = test & (F.col("write_nanos") <= t_to)
    return test


def under_prefix(prefix: str, tail: str) -> Column:
    """Whether the storage key, the logical key and a tail (':v' and digits, or ':current'), begins with prefix.

    Said over the logical key, so that it reaches the scan: the key begins with the prefix, or the
    prefix reaches into the tail of one key.
    """
    key = F.col("logical_key")
    if not prefix:
        return F.lit(True)
    test = key.startswith(prefix)
    cut = prefix.rfind(":")
    if cut >= 0 and tail == ":current" and tail.startswith(prefix[cut:]):
        test = test | (key == prefix[:cut])
    if cut >= 0 and tail == ":v" and re.fullmatch(r":(v[0-9]{0,20})?", prefix[cut:]):
        test = test | ((key == prefix[:cut]) & keys.version_key("logical_key", "seq").startswith(prefix))
    return test


def latest(ledger: DataFrame) -> DataFrame:
    """The version of the greatest seq of every key."""
    best = ledger.groupBy("logical_key").agg(F.max_by(F.struct(*_BODY), "seq").alias("v"))
    return best.select("logical_key", "v.*")


def as_of(ledger: DataFrame, nanos: int) -> DataFrame:
    """Of the versions written at or before nanos the one of the greatest seq, by key."""
    return latest(ledger.where(F.col("write_nanos") <= nanos))


def list_versions(ledger: DataFrame, logical_key: str) -> DataFrame:
    return ledger.where(F.col("logical_key") == logical_key).orderBy("seq")


def list_prefix(ledger: DataFrame, prefix: str, as_of_nanos: int = 0) -> DataFrame:
    """All versions under a prefix of the version key, up to a time if it is positive."""
    return ledger.where(under_prefix(prefix, ":v")).where(time_window(0, as_of_nanos))


def list_writes(ledger: DataFrame, prefix: str = "", t_from: int = 0, t_to: int = 0, source: str = "") -> DataFrame:
    """Envelopes with hash_ok in the order of key and seq."""
    found = list_prefix(ledger, prefix).where(time_window(t_from, t_to))
    if source:
        found = found.where(F.col("source") == source)
    return found.withColumn("hash_ok", hash_ok(F.col("payload"), F.col("persisted_hash"))).orderBy("logical_key", "seq")


def writes_by_source(ledger: DataFrame, prefix: str = "", t_from: int = 0, t_to: int = 0, source: str = "") -> DataFrame:
    found = list_prefix(ledger, prefix).where(time_window(t_from, t_to))
    if source:
        found = found.where(F.col("source") == source)
    return found.groupBy("source").agg(F.count("*").alias("writes")).orderBy("source")


def list_writes_page(ledger: DataFrame, limit: int, after: tuple[str, int] | None = None, **filters) -> DataFrame:
    """A page in the order of (logical_key, seq) after a cursor, with has_more; limit 0 has no bound."""
    found = list_writes(ledger, **filters)
    if after is not None:
        key, seq = after
        found = found.where((F.col("logical_key") > key) | ((F.col("logical_key") == key) & (F.col("seq") > seq)))
    if limit <= 0:
        return found.withColumn("has_more", F.lit(False))
    page = found.limit(limit + 1)
    place = F.row_number().over(Window.orderBy("logical_key", "seq"))  # limit + 1 rows at most
    whole = F.count("*").over(Window.partitionBy())
    return page.select("*", place.alias("_n"), (whole > limit).alias("has_more")).where(F.col("_n") <= limit).drop("_n")


def pages(ledger: DataFrame, limit: int, **filters):
    """All pages, as lists of rows, one after the other."""
    after = None
    while True:
        rows = list_writes_page(ledger, limit, after, **filters).collect()
        if rows:
            yield rows
        if not rows or not rows[0].has_more:
            return
        after = (rows[-1].logical_key, rows[-1].seq)


def assign_versions(incoming: DataFrame, ledger: DataFrame | None, order: str = "arrival") -> DataFrame:
    """incoming (logical_key, payload, source, schema_ver, write_nanos, arrival) as ledger rows with gap-free seq."""
    number = F.row_number().over(Window.partitionBy("logical_key").orderBy(order))
    rows = incoming.withColumn("_n", number.cast("long"))
    if ledger is not None:
        # only the incoming keys' versions reach the aggregation
        touched = ledger.select("logical_key", "seq").join(incoming.select("logical_key").distinct(), "logical_key", "left_semi")
        top = touched.groupBy("logical_key").agg(F.max("seq").alias("_top"))
        rows = rows.join(top, "logical_key", "left")
    else:
        rows = rows.withColumn("_top", F.lit(0).cast("long"))
    rows = rows.withColumn("seq", F.col("_n") + F.coalesce("_top", F.lit(0)))
    return rows.withColumn("persisted_hash", payload_hash(F.col("payload"))).select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA])


def append(incoming: DataFrame, path: str, order: str = "arrival") -> DataFrame:
    """Assign versions against the table at path and append them, partitioned by kind.

    One writer at a time: seq allocation is a critical section per key.
    """
    spark = incoming.sparkSession
    try:
        before = spark.read.parquet(path)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = None
    if before is not None and "kind" in before.columns:
        kinds = [r.kind for r in incoming.select(keys.kind_of("logical_key").alias("kind")).distinct().limit(MOST_KINDS + 1).collect()]
        if len(kinds) <= MOST_KINDS:  # a filter on partitions
            before = before.where(F.col("kind").isin(kinds))
    rows = assign_versions(incoming, before, order)
    rows.withColumn("kind", keys.kind_of("logical_key")).sortWithinPartitions("logical_key", "seq").write.mode("append").partitionBy("kind").parquet(path)
    return rows


def current_pointers(ledger: DataFrame) -> DataFrame:
    """(logical_key, seq, payload_hash): what each key's pointer should hold."""
    return latest(ledger).select("logical_key", "seq", payload_hash(F.col("payload")).alias("payload_hash"))


def mismatches(pointers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pointers without versions, or of another seq or hash than the latest version."""
    newest = current_pointers(ledger).toDF("_k", "_seq", "_hash")
    joined = pointers.join(newest, pointers.logical_key == newest["_k"], "left")
    wrong = F.col("_k").isNull() | ~F.col("seq").eqNullSafe(F.col("_seq")) | ~F.col("payload_hash").eqNullSafe(F.col("_hash"))
    why = F.when(F.col("_k").isNull(), "orphan").when(~F.col("seq").eqNullSafe(F.col("_seq")), "seq").otherwise("hash")
    return joined.where(wrong).select("logical_key", why.alias("reason"))


def orphan_pointers(pointers: DataFrame, ledger: DataFrame) -> DataFrame:
    return pointers.join(ledger, "logical_key", "left_anti").select("logical_key")


def _entry(key: Column, seq: Column, payload: Column) -> Column:
    """logical_key|seq|bytes|payload and a line feed, as bytes."""
    head = F.concat(key, F.lit("|"), seq.cast("string"), F.lit("|"), F.octet_length(payload).cast("string"), F.lit("|"))
    return F.concat(head.cast("binary"), payload.cast("binary"), F.lit("\n").cast("binary"))


def fingerprint(entries: DataFrame) -> DataFrame:
    """One row: key_count and the SHA-256 over all entries in order.

    SHA-256 is sequential, so one task sorts the entries, spilling, and streams them into the
    digest; fingerprint_tree is the distributed one.
    """

    def digest(batches):
        seen, count = hashlib.sha256(), 0
        for batch in batches:
            for entry in batch.column(0).to_pylist():
                seen.update(entry)
            count += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [count], "d": [seen.hexdigest()]})

    rows = entries.select("logical_key", "seq", _entry(F.col("logical_key"), F.col("seq"), F.col("payload")).alias("e"))
    folded = rows.repartition(1).sortWithinPartitions("logical_key", "seq").select("e").mapInArrow(digest, "n long, d string")
    empty = hashlib.sha256().hexdigest()
    return folded.agg(F.coalesce(F.max("n"), F.lit(0)).alias("key_count"), F.coalesce(F.max("d"), F.lit(empty)).alias("fingerprint"))


def fingerprint_streamed(entries: DataFrame) -> tuple[int, str]:
    """The same digest in constant driver memory, over a distributed sort."""
    digest, count = hashlib.sha256(), 0
    rows = entries.orderBy("logical_key", "seq").select(_entry(F.col("logical_key"), F.col("seq"), F.col("payload")).alias("e"))
    for row in rows.toLocalIterator(prefetchPartitions=True):
        digest.update(row.e)
        count += 1
    return count, digest.hexdigest()


def fingerprint_tree(entries: DataFrame, digits: int = 3) -> DataFrame:
    """Another digest, order-free and distributed: hashes of entries, of buckets by their first hex digits, and of all."""
    leaves = entries.select(F.sha2(_entry(F.col("logical_key"), F.col("seq"), F.col("payload")), 256).alias("leaf"))
    level = leaves.groupBy(F.substring("leaf", 1, digits).alias("b")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("leaf"))), 256).alias("node"), F.count("*").alias("n"))
    return level.agg(F.sum("n").alias("key_count"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.struct("b", "node")))["node"]), 256).alias("tree_fingerprint"))


def replay(ledger: DataFrame, pointers: DataFrame, prefix: str = "", as_of_nanos: int = 0) -> DataFrame:
    """One row: key_count, mismatches, fingerprint, bounded.

    The prefix is matched on the pointer's storage key.  A bounded replay counts all keys of the
    prefix, those without a version yet too, and checks no pointers.
    """
    hit = under_prefix(prefix, ":current")
    scoped, own = ledger.where(hit), pointers.where(hit)
    bounded = as_of_nanos > 0
    state = fingerprint(as_of(scoped, as_of_nanos) if bounded else latest(scoped)).select("fingerprint")
    count = own.agg(F.count("*").alias("key_count"))
    wrong = F.array().cast("array<string>") if bounded else F.col("mismatches")
    parts = count.crossJoin(state)  # single rows
    if not bounded:
        parts = parts.crossJoin(mismatches(own, scoped).agg(F.sort_array(F.collect_list("logical_key")).alias("mismatches")))
    return parts.select("key_count", wrong.alias("mismatches"), "fingerprint", F.lit(bounded).alias("bounded"))


def export_lines(ledger: DataFrame, **filters) -> DataFrame:
    """(logical_key, seq, line): the envelopes as JSON lines, and a manifest line, of null key and seq, with count and digest."""
    found = list_writes(ledger, **filters)
    body = F.struct(
        "logical_key", "seq", F.col("write_nanos").alias("write_ts"), "source", "schema_ver",
        payload_hash(F.col("payload")).alias("payload_hash"), F.base64("payload").alias("payload_b64"), "hash_ok",
    )
    lines = found.select("logical_key", "seq", F.to_json(body).alias("line"))
    manifest = fingerprint(found).select(
        F.lit(None).cast("string").alias("logical_key"),
        F.lit(None).cast("long").alias("seq"),
        F.to_json(F.struct(F.lit(True).alias("_manifest"), F.col("key_count").alias("count"), F.col("fingerprint").alias("export_fingerprint"))).alias("line"),
    )
    return lines.unionByName(manifest)
