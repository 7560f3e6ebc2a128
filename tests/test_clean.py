"""Predicates, contracts, cleaning and accounting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tempolith.functions.predicate import field_predicate, redact
from tempolith.operators import clean

BASE = dict(code="600000", date="2026-08-17", open=10.0, high=10.5, low=9.8, close=10.2, volume=1000000, prev_close=10.0)
CASES = [
    ('{"az": 9.95}', "az", ">", "9.9", True), ('{"az": "9.95"}', "az", ">", "9.9", True), ('{"az": 9.9}', "az", ">", "9.9", False), ('{"az": 9.9}', "az", ">=", "9.9", True),
    ('{"az": 1}', "az", "<", "2", True), ('{"az": 2}', "az", "<=", "2", True), ('{"s": "on"}', "s", "==", "on", True), ('{"s": "on"}', "s", "!=", "off", True),
    ('{"s": "on"}', "t", "!=", "off", False), ("not json", "s", "!=", "x", False), ('{"az": 1}', "az", ">", "abc", False), ('{"a.b": 3}', "a.b", ">", "2", True), ("anything", "", "", "", True),
    ('{"n": null}', "n", ">", "-1", True), ('{"n": null}', "n", "==", "", True), ("[1]", "n", "!=", "1", False), ('{"b": true}', "b", "==", "true", True),
]


@pytest.mark.parametrize("value,field,op,operand,want", CASES)
def test_predicate(spark, value, field, op, operand, want):
    df = spark.createDataFrame([(value,)], "v string")
    for raw in (False, True):
        assert df.select(field_predicate(F.col("v"), field, op, operand, raw_text=raw)).first()[0] is want


def test_raw_text_equality(spark):
    df = spark.createDataFrame([('{"n": 1.50, "o": {"a": 1}}',)], "v string")
    test = lambda f, x: df.select(field_predicate(F.col("v"), f, "==", x, raw_text=True)).first()[0]
    assert test("n", "1.50") and not test("n", "1.5") and test("o", '{"a": 1}')


def test_redact(spark):
    rows = [('{"ax":0.01,"gps":"39.9,116.4","user_id":"u123"}',), ('{"b": 1.50}',), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(redact(F.col("v"), ["gps", "user_id"])).collect()]
    assert json.loads(got[0]) == {"ax": 0.01, "gps": "[REDACTED]", "user_id": "[REDACTED]"} and got[1:] == ['{"b": 1.50}', "plain"]


def test_redact_keeps_raw_members(spark):
    rows = ['{"gps":1,"gps":2}', '{"gps":0, "b":1.50,"a":1e400}', '{"n":{"gps": 1}}', '{"\\u0067ps":1,"z":"<&"}', '{"gps":NaN}', '{"gps":1} x', None, '{"gps":1,"\u00e9":"a  b"}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(redact(F.col("v"), ["gps"])).collect()]
    assert got == [
        '{"gps":"[REDACTED]"}', '{"a":1e400,"b":1.50,"gps":"[REDACTED]"}', rows[2], '{"gps":"[REDACTED]","z":"\\u003c\\u0026"}', rows[4], rows[5], None, '{"gps":"[REDACTED]","\u00e9":"a  b"}',
    ]


def test_repeated_members_take_the_last(spark):
    df = spark.createDataFrame([('{"n":1,"n":5}',)], "v string")
    for raw in (False, True):
        assert df.select(field_predicate(F.col("v"), "n", ">", "4", raw_text=raw)).first()[0] and df.select(field_predicate(F.col("v"), "n", "==", "5", raw_text=raw)).first()[0]


def test_monotonic_spreads_keys_without_a_time(spark):
    df = spark.range(4000).select(F.col("id").alias("arrival"), F.lit("plain").alias("key"))
    sizes = clean.monotonic(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r[1] for r in sizes) < 3000


QUOTES = [
    ({}, 0), ({"open": -1}, 0x3002), ({"open": 0}, 0x3002), ({"volume": -1}, 0x3002), ({"volume": 0}, 0), ({"low": 10.1}, 0x3003), ({"open": 11}, 0x3003), ({"close": 9}, 0x3003),
    ({"close": 13.0, "high": 13.0}, 0x3004), ({"close": 7.0, "low": 7.0}, 0x3004), ({"close": 12.11, "high": 13}, 0x3004), ({"close": 12.1, "high": 13}, 0), ({"close": 8.47, "open": 8, "high": 9, "low": 7, "prev_close": 7.0}, 0x3004), ({"prev_close": 0}, 0), ({"prev_close": None}, 0),
    *[({f: None}, 0x3001) for f in ("code", "date", "open", "high", "low", "close", "volume")],
]


@pytest.mark.parametrize("change,want", QUOTES)
def test_quote_codes(spark, change, want):
    body = {k: v for k, v in (BASE | change).items() if v is not None}
    assert spark.createDataFrame([(json.dumps(body),)], "v string").select(clean.quote_code(F.col("v"))).first()[0] == want


def test_not_json_is_missing(spark):
    assert spark.createDataFrame([("nope",)], "v string").select(clean.quote_code(F.col("v"))).first()[0] == 0x3001


def contracts(spark):
    return spark.createDataFrame([(1, "quote", "quote:"), (2, "deep", "quote:x:")], "type_id int, name string, key_prefix string")


def test_longest_prefix_wins(spark):
    got = clean.with_contract(spark.createDataFrame([("quote:1",), ("quote:x:1",), ("other",)], "key string"), contracts(spark)).collect()
    assert [r.contract for r in got] == ["quote", "deep", None]


def test_monotonic(spark):
    rows = [(i, k) for i, k in enumerate(["imu:dev0:100", "imu:dev0:99", "imu:dev0:100", "imu:dev0:101", "imu:dev1:1", "plain"])]
    got = clean.monotonic(spark.createDataFrame(rows, "arrival int, key string")).orderBy("arrival").collect()
    assert [r.backward for r in got] == [False, True, True, False, False, False]


def test_monotonic_equals_the_state_machine(spark):
    rng = random.Random(3)
    rows = [(i, f"d{rng.randrange(3)}:{rng.randrange(50)}") for i in range(200)]
    got = {r.arrival: r.backward for r in clean.monotonic(spark.createDataFrame(rows, "arrival int, key string")).collect()}
    last = {}
    for i, key in rows:
        device, t = key.split(":")
        late = int(t) <= last.get(device, -1)
        assert got[i] is late
        if not late:
            last[device] = int(t)


def test_clean_order_and_variants(spark):
    big = "x" * 50
    rows = [(0, "imu:d:5", '{"gps": "1"}', 0), (1, "imu:d:4", "{}", 0), (2, "quote:1", json.dumps(BASE), 0), (3, "quote:2", "{}", 0), (4, "imu:d:9", big, 0), (5, "imu:d:3", "{}", 7), (6, "imu:d:2", json.dumps(BASE), 1)]
    df = spark.createDataFrame(rows, "arrival int, key string, value string, type_id int")
    plain = {r.arrival: r for r in clean.clean(df.drop("type_id"), contracts(spark), max_bytes=0).collect()}
    assert plain[0].value == '{"gps":"[REDACTED]"}' and plain[1].reason == "non_monotonic_timestamp" and plain[2].result == "accept" and plain[3].code == 0x3001
    sized = {r.arrival: r for r in clean.clean(df.drop("type_id"), contracts(spark), max_bytes=40).collect()}
    assert sized[4].reason == "oversized_value"
    declared = {r.arrival: r for r in clean.clean(df.select("arrival", "key", "type_id", "value"), contracts(spark), declared=True).collect()}
    assert declared[5].reason == "unknown_declared_type" and declared[6].result == "accept" and declared[1].reason == "non_monotonic_timestamp"
    versioned = {r.arrival: r for r in clean.clean(df.drop("type_id"), contracts(spark), versioned=True).collect()}
    assert versioned[1].result == "accept"


def test_ack_windows_equal_the_sequential_machine(spark):
    rng, corr, rows = random.Random(5), 0, []
    for i in range(120):
        corr += rng.random() < 0.1
        rows.append((1, i, corr, "drop" if rng.random() < 0.3 else "accept", f"r{i}"))
    got = clean.ack_windows(spark.createDataFrame(rows, "conn int, arrival int, corr_id int, result string, reason string"), most=7).orderBy("island", "part").collect()
    want, now = [], None
    for _, _, c, result, reason in rows:
        if now is None or now[0] != c or now[1] == 7:
            now = [c, 0, 0, None]
            want.append(now)
        now[1] += 1
        if result == "drop":
            now[2] += 1
            now[3] = now[3] or reason
    assert [[r.corr_id, r.received, r.rejected, r.first_error] for r in got] == want
    assert all(r.received == r.accepted + r.rejected for r in got)
