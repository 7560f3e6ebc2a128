"""From raw documents to packed training sequences: five stages over the operators of tempolith.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolith.llm import decontam, line_dedup, packing, quality_rules, simhash
from tempolith.llm.common import materialize
from tempolith.llm.queries import tokenizer_path


def reject_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source."""
    return quality_rules.keep_regular(docs)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of their source share go."""
    return line_dedup.drop_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more items go; single items' passages are cut out."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row for each piece: where it lies, its ids and their checksum."""
    pieces = packing.pack_sequences(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", reject_outliers),
    ("line_dedup", cut_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("packing", pack),
]

#: Outlier estimation, fingerprint components and tokenisation are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
