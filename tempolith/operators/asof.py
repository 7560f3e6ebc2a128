"""As-of joins for many instants: seq order may disagree with time, so the answer is a running maximum of seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(probes: DataFrame, ledger: DataFrame) -> DataFrame:
    """probes (logical_key, at, ...) with seq and payload of the version each sees; one shuffle, no join.

    Versions and probes are merged in time order per key; a probe sees versions of its own instant.
    """
    extra = [c for c in probes.columns if c not in ("logical_key", "at")]
    rows = ledger.select("logical_key", F.col("write_nanos").alias("at"), F.struct("seq", "payload").alias("_v"), F.lit(0).alias("_o"), F.lit(None).cast(probes.select(F.struct(*extra) if extra else F.struct("at")).schema[0].dataType).alias("_p"))
    asks = probes.select("logical_key", "at", F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_o"), (F.struct(*extra) if extra else F.struct("at")).alias("_p"))
    order = Window.partitionBy("logical_key").orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(asks).withColumn("_s", F.max("_v").over(order)).where("_o = 1")
    return seen.select("logical_key", "at", *[F.col(f"_p.{c}").alias(c) for c in extra], F.col("_s.seq").alias("seq"), F.col("_s.payload").alias("payload"))


def visibility(ledger: DataFrame) -> DataFrame:
    """(logical_key, from_nanos, to_nanos, seq, payload): which version is seen when; to_nanos is excluded, null is open."""
    run = Window.partitionBy("logical_key").orderBy("write_nanos").rangeBetween(Window.unboundedPreceding, 0)
    seen = ledger.select("logical_key", "write_nanos", F.max(F.struct("seq", "payload")).over(run).alias("v")).distinct()
    order = Window.partitionBy("logical_key").orderBy("write_nanos")
    return seen.select("logical_key", F.col("write_nanos").alias("from_nanos"), F.lead("write_nanos").over(order).alias("to_nanos"), "v.seq", "v.payload")
