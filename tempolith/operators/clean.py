"""Cleaning of incoming records: size, monotonicity, schema, redaction, in that order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.predicate import redact
from ..schema import CODES, QUOTE_SCHEMA

#: The most a price may move against the previous close.
MAX_CHANGE = 0.21


def quote_code(value: Column) -> Column:
    """0 for a valid quote, else the code of the first rule it breaks; the value is parsed once."""
    return F.get(F.transform(F.array(F.from_json(value, QUOTE_SCHEMA)), _code_of), F.lit(0))


def _code_of(q: Column) -> Column:
    missing = F.lit(False) | q.isNull()
    for f in ("code", "date", "open", "high", "low", "close", "volume"):
        missing = missing | q[f].isNull()
    missing = missing | (q["code"] == "") | (q["date"] == "")
    low, high = q["low"], q["high"]
    bad_price = (q["open"] <= 0) | (high <= 0) | (low <= 0) | (q["close"] <= 0) | (q["volume"] < 0)
    bad_order = (low > q["open"]) | (q["open"] > high) | (low > q["close"]) | (q["close"] > high)
    change = F.when(q["prev_close"].isNotNull() & (q["prev_close"] != 0), F.abs((q["close"] - q["prev_close"]) / q["prev_close"]))
    return (
        F.when(F.coalesce(missing, F.lit(True)), CODES["missing_field"])
        .when(bad_price, CODES["bad_price"])
        .when(bad_order, CODES["ohlc"])
        .when(F.coalesce(change > MAX_CHANGE, F.lit(False)), CODES["pct_change"])
        .otherwise(0)
    )


def change_check_skipped(value: Column) -> Column:
    """Whether a quote lacks the previous close that the change check needs."""
    prev = F.from_json(value, QUOTE_SCHEMA)["prev_close"]
    return prev.isNull() | (prev == 0)


#: Validators by contract name: functions of the value that give a code, 0 for valid.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"quote": quote_code}


def register_validator(name: str, validator: Callable[[Column], Column]) -> None:
    VALIDATORS[name] = validator


def with_contract(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """records with the contract (name, type_id) of the longest matching key prefix; null without one.

    contracts (name, type_id, key_prefix) is a catalog of a handful of rows, loaded by the driver.
    """
    c = contracts.where("key_prefix <> ''").select(F.col("name").alias("contract"), F.col("type_id").alias("contract_type"), "key_prefix")
    prefixes = [(r.contract, r.contract_type, r.key_prefix) for r in c.collect()]
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("int")
    for contract, type_id, prefix in sorted(prefixes, key=lambda x: len(x[2])):  # the longest is tested first
        hit = F.col("key").startswith(prefix)
        name, kind = F.when(hit, contract).otherwise(name), F.when(hit, type_id).otherwise(kind)
    return records.withColumns({"contract": name, "contract_type": kind})


def with_declared_contract(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """records with the contract of their declared type_id, null for unknown types."""
    c = contracts.where("type_id <> 0").select(F.col("name").alias("contract"), F.col("type_id").cast("int").alias("contract_type"))
    return records.join(F.broadcast(c), records.type_id == c.contract_type, "left")  # a catalog of a handful of rows


def monotonic(records: DataFrame, arrival: str = "arrival", bound: Column | None = None) -> DataFrame:
    """records with ``backward``: whether the key's time is no greater than an earlier one of its device.

    Rejected rows never exceed the running maximum, so it equals that of the accepted rows.  Rows
    that ``bound`` (all by default) leaves out, and keys without a time, neither are backward nor
    move the maximum; they are spread over the window's tasks.
    """
    device, ts = keys.device_and_ts("key")
    before = Window.partitionBy("_device").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    held = ts.isNotNull() & (F.lit(True) if bound is None else F.coalesce(bound, F.lit(False)))
    free = F.concat(F.lit("\x01"), F.xxhash64("key", arrival).cast("string"))
    r = records.withColumns({"_device": F.when(held, device).otherwise(free), "_ts": F.when(held, ts)})
    late = F.col("_ts").isNotNull() & (F.col("_ts") <= F.max("_ts").over(before))
    return r.withColumn("backward", F.coalesce(late, F.lit(False))).drop("_device", "_ts")


def clean(
    records: DataFrame,
    contracts: DataFrame,
    *,
    max_bytes: int = 0,
    drop_backward: bool = True,
    redact_fields: tuple[str, ...] = ("gps", "user_id"),
    versioned: bool = False,
    declared: bool = False,
) -> DataFrame:
    """records (arrival, key, value, ...) with result ('accept' or 'drop'), code, reason and the value to store.

    Monotonicity binds only keys without a contract; versioned writes and declared types skip it.
    declared: the type_id column, where it is not 0, names the contract.
    """
    r = with_contract(records, contracts)
    unknown = F.lit(False)
    if declared:
        by_type = with_declared_contract(r.drop("contract_type").withColumnRenamed("contract", "_by_key"), contracts)
        named = F.coalesce(F.col("type_id") != 0, F.lit(False))
        unknown = named & F.col("contract_type").isNull()
        r = by_type.withColumn("contract", F.when(named, F.col("contract")).otherwise(F.col("_by_key")))
    exempt = F.col("contract").isNotNull()
    if declared:
        exempt = exempt | F.coalesce(F.col("type_id") != 0, F.lit(False))
    large = F.coalesce(F.lit(max_bytes > 0) & (F.octet_length("value") > max_bytes), F.lit(False))
    r = r.withColumn("backward", F.lit(False)) if versioned or not drop_backward else monotonic(r, bound=~exempt & ~large)
    code = F.lit(0)
    for name, validator in VALIDATORS.items():
        code = F.when(F.col("contract") == name, validator(F.col("value"))).otherwise(code)
    reason = (
        F.when(large, "oversized_value")
        .when(unknown, "unknown_declared_type")
        .when(F.col("backward"), "non_monotonic_timestamp")
        .when(F.col("_code") != 0, "schema")
    )
    r = r.withColumn("_code", code).withColumn("reason", reason)
    stored = redact(F.col("value"), list(redact_fields)) if redact_fields else F.col("value")
    return r.select(
        *[F.col(f"`{c}`") for c in records.columns if c != "value"],
        F.when(F.col("reason").isNull(), "accept").otherwise("drop").alias("result"),
        F.when(F.col("reason") == "schema", F.col("_code")).otherwise(0).alias("code"),
        "reason",
        F.when(F.col("reason").isNull(), stored).alias("value"),
    )


def role_violations(writes: DataFrame) -> DataFrame:
    """Writes (logical_key, source) by agents outside proposal keys, with the code they get."""
    bad = (keys.source_role("source") == "agent") & ~keys.is_proposal_key("logical_key")
    return writes.where(bad).withColumn("code", F.lit(CODES["role"]))


def accounting(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """received, accepted, rejected and the first error (reason) of results (arrival, result, reason)."""
    bad = F.col("result") == "drop"
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("received"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"),
        F.min_by(F.when(bad, F.col("reason")), F.when(bad, F.col("arrival"))).alias("first_error"),
    )


def ack_windows(results: DataFrame, most: int = 1000) -> DataFrame:
    """Windows of results (conn, arrival, corr_id, result, reason): a new one at each change of corr_id or after ``most`` rows."""
    order = Window.partitionBy("conn").orderBy("arrival")
    changed = (~F.col("corr_id").eqNullSafe(F.lag("corr_id").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    island = F.sum("_c").over(order)
    number = F.row_number().over(Window.partitionBy("conn", "_island").orderBy("arrival"))
    rows = results.withColumn("_c", changed).withColumn("_island", island).withColumn("_part", F.floor((number - 1) / most))
    return accounting(rows, ["conn", "corr_id", "_island", "_part"]).withColumnsRenamed({"_island": "island", "_part": "part"})
