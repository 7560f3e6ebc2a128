"""Helpers shared by the operators: shared scratch tables and word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python agree on this class: a space or one of tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.  Set here only for local masters without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back; cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tempolith/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs without white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """table, marked for broadcast if its counted rows are at most ``rows``; meant for written tables of short rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def drawn(df: DataFrame, key: Column, rows: int, count: int) -> DataFrame:
    """At most ``rows`` rows of df, which has ``count``, by a hash of key; few more rows reach the sort than leave it."""
    spread = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40))
    least = int((1 << 40) * min(1.0, 2 * rows / max(count, 1)))
    return df.where(spread < least).orderBy(spread, key).limit(rows)


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row is told apart and ordered by: its id, null last, then hashes of its text and of all its columns."""
    every = [x for c in df.columns for x in (F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").isNull())]
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"), F.xxhash64(*every).alias("row"))


def keep_rows(keyed: DataFrame, key: str, winners: DataFrame) -> DataFrame:
    """Rows of keyed whose row_key in the column ``key`` is among winners.who, one for each; the column goes."""
    mine, n = fresh(keyed, "winner"), fresh(keyed, "times")
    chosen = materialize(winners.select(F.col("who").alias(mine)), "winners")
    kept = keyed.join(chosen, F.col(key) == F.col(mine), "left_semi")
    # only rows repeated as a whole share a key; they are few, and the others need no look at each other
    again = materialize(keyed.select(key).join(chosen, F.col(key) == F.col(mine), "left_semi").groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col(key).alias(mine)), "winners-again")
    if not again.head(1):
        return kept.drop(key)
    once = kept.join(again, F.col(key) == F.col(mine), "left_anti")
    return once.union(kept.join(again, F.col(key) == F.col(mine), "left_semi").dropDuplicates([key])).drop(key)
