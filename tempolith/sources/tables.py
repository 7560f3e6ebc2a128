"""The ledger table, the ledger derived from an event stream, and imports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.codec import decode_pointers, decode_records
from ..functions.scalars import payload_hash
from ..schema import EXPERIMENT_SCHEMA, LEDGER_SCHEMA

DAY_MICROS = 86_400_000_000
#: Fixed value: bytes of the longest line of a registry file.
MOST_LINE_BYTES = 8 << 20
_CONTRACT_FIELDS = frozenset(
    "type_id name schema_version schema_version_note key_prefix key_layout time_semantics producer consumers pit_semantics idempotency_key "
    "required_fields units validation_rules error_codes note".split()
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; filters on kind prune partitions, filters on keys prune row groups."""
    return spark.read.parquet(path).select(*[f.name for f in LEDGER_SCHEMA], "kind")


def events_ledger(events: DataFrame) -> DataFrame:
    """A ledger with a version for each event: keys are type and user, and every seventh event's clock ran a day behind."""
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select(
        F.concat(F.lit("evt:"), "event_type", F.lit(":"), F.col("user_id").cast("string")).alias("logical_key"),
        F.row_number().over(order).cast("long").alias("seq"),
        (micros - F.when(F.col("event_id") % 7 == 0, DAY_MICROS).otherwise(0)).alias("write_nanos"),
        F.concat(F.lit("src-"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.lit(1).alias("schema_ver"),
        payload_hash(F.col("props").cast("binary")).alias("persisted_hash"),
        F.col("props").cast("binary").alias("payload"),
    )


def import_raw(dump: DataFrame) -> DataFrame:
    """Ledger rows of a raw dump (key, value binary): version keys with decodable records."""
    split = dump.where(keys.is_version_key("key")).select(keys.parse_version_key("key").alias("k"), decode_records("value").alias("r"))
    return split.where("r.write_nanos is not null").select("k.logical_key", F.col("k.seq").cast("long").alias("seq"), "r.*")


def import_pointers(dump: DataFrame) -> DataFrame:
    """(logical_key, seq, payload_hash) of the current pointers of a raw dump (key, value binary)."""
    own = dump.where(keys.is_current_key("key")).select(F.expr(f"left(key, char_length(key) - {len(':current')})").alias("logical_key"), decode_pointers("value").alias("p"))
    return own.where("p.seq is not null").select("logical_key", "p.seq", "p.payload_hash")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): the lines of text files with their numbers from 1; counts of file splits are added up."""
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n")
    )
    splits = text.groupBy("file", "_at").agg(F.count("*").alias("_size"), F.min("_n").alias("_first"))
    before = F.sum("_size").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    offset = splits.select("file", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return text.join(offset, ["file", "_at"]).select("value", "file", (F.col("_before") + F.col("_n") - F.col("_first") + 1).alias("line"))


def import_registry(lines: DataFrame, latest: DataFrame, source: str = "registry-import") -> tuple[DataFrame, DataFrame]:
    """(classified, writes) of JSON lines (value, line): imported, unchanged or error with its reason; blank lines are skipped.

    A line is compared with the one before it of its key, the first one with the ledger.  writes
    holds ledger writes (logical_key, payload, source, arrival) of what is new.  Without a column
    ``line`` rows count in the order of the frame.
    """
    if "line" not in lines.columns:
        lines = lines.withColumn("line", F.monotonically_increasing_id() + 1)
    text = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", EXPERIMENT_SCHEMA))
    reason = (
        F.when(F.octet_length("value") > MOST_LINE_BYTES, "line too long")
        .when(F.from_json("value", "map<string,string>").isNull(), "not a JSON object")
        .when(F.coalesce(F.col("r.verdict.fingerprint"), F.lit("")) == "", "verdict.fingerprint is empty")
    )
    keyed = text.select("value", "line", reason.alias("reason"), F.concat(F.lit(keys.OBJECT_PREFIXES["experiment"]), "r.verdict.fingerprint").alias("_key"))
    keyed = keyed.withColumn("logical_key", F.when(F.col("reason").isNull(), F.col("_key"))).drop("_key")
    good = keyed.where("reason is null").withColumn("_before", F.lag("value").over(Window.partitionBy("logical_key").orderBy("line")))
    old = latest.select(F.col("logical_key").alias("_k"), F.col("payload").cast("string").alias("_p"))
    joined = good.join(old, good.logical_key == F.col("_k"), "left")
    outcome = F.when(F.coalesce("_before", "_p") == F.col("value"), "unchanged").otherwise("imported")
    columns = ["value", "line", "logical_key", "reason"]
    classified = joined.select(*columns, outcome.alias("outcome")).union(keyed.where("reason is not null").select(*columns, F.lit("error").alias("outcome")))
    new = classified.where("outcome = 'imported'")
    writes = new.select("logical_key", F.col("value").cast("binary").alias("payload"), F.lit(source).alias("source"), F.col("line").alias("arrival"))
    return classified, writes


def import_summary(classified: DataFrame) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return classified.agg(F.count("*").alias("total"), count("imported").alias("imported"), count("unchanged").alias("unchanged"), count("error").alias("errors"))


def load_contracts(spark: SparkSession, folder: str, validators: set[str] | None = None) -> tuple[DataFrame, str]:
    """(contracts, digest) of the *.schema.json files of a folder the driver reads; unknown fields are refused."""
    import hashlib

    rows, digest = [], hashlib.sha256()
    for path in sorted(Path(folder).glob("*.schema.json")):
        raw = path.read_bytes()
        spec = json.loads(raw)
        if unknown := set(spec) - _CONTRACT_FIELDS:
            raise ValueError(f"{path.name}: unknown fields {sorted(unknown)}")
        if spec.get("time_semantics", {}).get("kind", "none") not in ("none", "key_field", "payload_field", "monotonic"):
            raise ValueError(f"{path.name}: unknown time kind")
        if validators is not None and spec["name"] not in validators and spec.get("validation_rules"):
            raise ValueError(f"{path.name}: no validator {spec['name']!r}")
        digest.update(raw)
        rows.append((int(spec["type_id"]), spec["name"], int(spec.get("schema_version", 0)), spec.get("key_prefix", ""), list(spec.get("required_fields", []))))
    rows.sort()
    return spark.createDataFrame(rows, "type_id int, name string, schema_version int, key_prefix string, required_fields array<string>"), digest.hexdigest()


def load_redlines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(redlines in the order of id, digest of the raw bytes) of a JSON file."""
    redlines = spark.read.option("multiLine", True).json(path).select(F.explode("redlines").alias("r")).select("r.*").orderBy("id")
    return redlines, spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"))


def file_catalog(spark: SparkSession, path: str, key_col: str = "key") -> DataFrame:
    """(path, bytes, rows, min_key, max_key, modified) of a table's files, from a scan of the key column alone."""
    meta = F.col("_metadata")
    table = spark.read.parquet(path).select(F.col(key_col).alias("key"), meta["file_path"].alias("path"), meta["file_size"].alias("bytes"), meta["file_modification_time"].alias("modified"))
    return table.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("modified").alias("modified"))


def delete_files(spark: SparkSession, paths) -> int:
    """Delete files by path through the file system that holds them."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(target.getFileSystem(conf).delete(target, False))
    return n


def replace_table(spark: SparkSession, path: str, new: str) -> None:
    """Put the written folder ``new`` in the place of ``path``; the old folder goes last."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, f"{path}.old"))
    fs = at.getFileSystem(conf)
    if not fs.rename(at, old) or not fs.rename(fresh, at):
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)
