"""Connected components by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least)


def component_roots(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node with an edge, root the least node of its component.

    edges has the columns u and v of an ordered type; loops and repeats do no harm.  Each round
    is written, so a lost executor costs one round; rounds grow with the logarithm of the size.
    """
    now = materialize(edges.where("u <> v").distinct(), tag)
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark.n or mark == seen:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(now.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
        seen = mark
        now = materialize(_small_star(_large_star(now).where("u <> v")).where("u <> v").distinct(), tag)
