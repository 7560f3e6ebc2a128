"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hmm, html_extract, html_pages, line_dedup, packing, quality_rules, secret_scan, simhash, suffix_dedup, token_counts


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed collection lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = html_extract.fit(html_pages.labelled_pages(400, seed=1))
    return html_extract.extract(_table(spark, sf_dir, "pages"), field)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_report(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontam.REPORT_SQL, "op10_line_dedup": line_dedup.LINE_SQL}
