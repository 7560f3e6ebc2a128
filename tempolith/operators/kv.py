"""Key/value change logs: newest wins, tombstones, scans, and version resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.predicate import field_predicate
from .ledger import latest


def newest(changes: DataFrame, recency: str = "arrival") -> DataFrame:
    """The last change (key, value, op) of every key, tombstones included."""
    best = changes.groupBy("key").agg(F.max_by(F.struct("value", "op"), recency).alias("c"))
    return best.select("key", "c.value", "c.op")


def current(changes: DataFrame, recency: str = "arrival") -> DataFrame:
    """The live (key, value): deleted keys are absent, empty values are not."""
    return newest(changes, recency).where("op <> 'D'").drop("op")


def merge(*runs: DataFrame) -> DataFrame:
    """Runs of changes (key, value, op) as one, later runs winning; tombstones stay (compaction)."""
    tagged = [r.select("key", "value", "op", F.lit(i).alias("_run")) for i, r in enumerate(runs)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return newest(both, "_run")


def scan_range(kv: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Keys of the closed range; an empty end is open."""
    if start:
        kv = kv.where(F.col("key") >= start)
    if end:
        kv = kv.where(F.col("key") <= end)
    return kv


def scan(kv: DataFrame, start: str = "", end: str = "", field: str = "", op: str = "", operand: str = "", limit: int = 10_000, raw_text: bool = False, ordered: bool = True) -> DataFrame:
    """Business scan: a range without internal keys, a predicate on the JSON value, in key order, capped; limit 0 has no cap.

    Without a cap, ``ordered=False`` saves the sort.
    """
    found = scan_range(kv, start, end).where(~keys.is_internal("key"))
    found = found.where(field_predicate(F.col("value"), field, op, operand, raw_text=raw_text))
    return found.orderBy("key").limit(limit) if limit > 0 else found.orderBy("key") if ordered else found


def get(kv: DataFrame, key: str) -> DataFrame:
    """The (key, value) of one key, none if it is absent."""
    return kv.where(F.col("key") == key)


def scan_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(F.col("key").startswith(prefix))


def get_transparent(kv: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, value): the plain value, or else the latest version's payload."""
    versions = latest(ledger).select(F.col("logical_key").alias("key"), F.col("payload").cast("string").alias("_payload"))
    return kv.join(versions, "key", "full").select("key", F.coalesce("value", "_payload").alias("value"))


def dereference(pointers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payloads that (logical_key, seq) pointers name."""
    return pointers.select("logical_key", "seq").join(ledger, ["logical_key", "seq"]).select("logical_key", "seq", "payload")


def delivery_batch(kv: DataFrame, cursor: str = "", limit: int = 100) -> DataFrame:
    """Up to limit records at or after the cursor in key order, reserved keys skipped."""
    found = kv.where(~F.col("key").startswith(keys.OFFSET_PREFIX))
    if cursor:
        found = found.where(F.col("key") >= cursor)
    return found.orderBy("key").limit(limit)


def next_cursor(last_key: str) -> str:
    """The least key after last_key."""
    return last_key + "\0"


def reclaimable(files: DataFrame, delivered: str) -> DataFrame:
    """Files (path, max_key) that hold nothing at or after the delivered cursor."""
    return files.where(F.col("max_key") < delivered)
