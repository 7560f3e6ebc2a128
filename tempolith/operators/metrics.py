"""Latency statistics, smoothed latencies and process counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def latency_stats(samples: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, max and the 50th, 95th and 99th percentile by key."""
    p = lambda q: F.percentile(value, F.lit(q))
    return samples.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def ewma(samples: DataFrame, by: str, order: str, value: str, weight: float = 0.2) -> DataFrame:
    """(by, ewma): exponentially weighted mean in order; a sample counts weight * (1 - weight) ** (samples after it).

    The first sample starts the mean, so its share has no factor ``weight``.
    """
    after = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) - 1
    first = F.lead(F.lit(False), 1, True).over(Window.partitionBy(by).orderBy(F.desc(order)))
    share = F.pow(F.lit(1.0 - weight), F.col("_after").cast("double")) * F.when(F.col("_first"), 1.0).otherwise(weight)
    rows = samples.select(by, F.col(value).cast("double").alias("_v"), after.alias("_after"), first.alias("_first"))
    return rows.groupBy(by).agg(F.sum(F.col("_v") * share).alias("ewma"))


def counted(df: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """df with counters observed while it runs."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen
