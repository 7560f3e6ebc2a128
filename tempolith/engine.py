"""The facade: a data folder with a ledger and a key/value change log."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .operators import jobs, kv, ledger, plane
from .schema import CODES, EDGE_SCHEMA, LEDGER_SCHEMA
from .sources import tables

_CHANGES = "key string, value string, op string, arrival bigint, tag string"


class RoleError(PermissionError):
    code = CODES["role"]


class SuspectDuplicateError(ValueError):
    """An admitted factor is too similar."""


class Engine:
    """Reads are DataFrames; writes append.  One writer at a time: seqs are allocated per key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._counts = {"received": 0, "accepted": 0, "rejected": 0}

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as error:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER_SCHEMA)

    @property
    def changes(self) -> DataFrame:
        return self._table("changes", _CHANGES)

    # plain keys

    def put_many(self, rows: Iterable[tuple[str, str]]) -> None:
        self._change([(k, v, "P") for k, v in rows])

    def put(self, key: str, value: str) -> None:
        self.put_many([(key, value)])

    def delete(self, key: str) -> None:
        """A tombstone for the plain key; versions of it stay."""
        self._change([(key, None, "D")])

    def _change(self, rows: list[tuple]) -> None:
        now, tag = time.time_ns(), uuid.uuid4().hex
        data = [(*r, now + i, tag) for i, r in enumerate(rows)]
        self.spark.createDataFrame(data, _CHANGES).write.mode("append").parquet(f"{self.folder}/changes")

    def get(self, key: str) -> str | None:
        """The plain value, or else the latest version's payload."""
        own = kv.current(self.changes.where(F.col("key") == key)).select("key", "value")
        row = kv.get_transparent(own, self.ledger.where(F.col("logical_key") == key)).first()
        return row.value if row else None

    def scan(self, start: str = "", end: str = "", field: str = "", op: str = "", operand: str = "", limit: int = 10_000) -> DataFrame:
        return kv.scan(kv.current(self.changes), start, end, field, op, operand, limit, raw_text=op in ("==", "!="))

    # versions

    def put_versioned(self, key: str, payload: bytes, source: str = "", schema_ver: int = 1, write_nanos: int | None = None) -> int:
        """The seq of the new version; agents may write proposals alone."""
        if source.startswith("agent:") and not key.startswith("proposal:"):
            raise RoleError(f"{source} may not write {key}")
        now = write_nanos if write_nanos is not None else time.time_ns()
        return self.append([(key, payload, source, schema_ver, now, 0)])[0].seq

    def append(self, rows: list[tuple]) -> list[Row]:
        """Append (logical_key, payload, source, schema_ver, write_nanos, arrival); returns keys and seqs."""
        schema = "logical_key string, payload binary, source string, schema_ver int, write_nanos bigint, arrival bigint"
        incoming = self.spark.createDataFrame(rows, schema)
        touched = self.ledger.where(F.col("logical_key").isin(sorted({r[0] for r in rows})))
        new = ledger.assign_versions(incoming, touched).collect()  # the caller's rows
        frame = self.spark.createDataFrame(new, LEDGER_SCHEMA).withColumn("kind", keys.kind_of("logical_key"))
        frame.write.mode("append").partitionBy("kind").parquet(f"{self.folder}/ledger")
        return [Row(logical_key=r.logical_key, seq=r.seq) for r in new]

    def get_as_of(self, key: str, nanos: int) -> Row | None:
        return ledger.as_of(self.ledger.where(F.col("logical_key") == key), nanos).first()

    def list_versions(self, key: str) -> DataFrame:
        return ledger.list_versions(self.ledger, key)

    def list_writes(self, prefix: str = "", t_from: int = 0, t_to: int = 0, source: str = "") -> DataFrame:
        return ledger.list_writes(self.ledger, prefix, t_from, t_to, source)

    def list_writes_all(self, page_size: int = 1000, **filters):
        for page in ledger.pages(self.ledger, page_size, **filters):
            yield from page

    def replay_fingerprint(self, prefix: str = "", as_of_nanos: int = 0, pointers: DataFrame | None = None) -> Row:
        return ledger.replay(self.ledger, pointers if pointers is not None else ledger.current_pointers(self.ledger), prefix, as_of_nanos).first()

    def export_writes(self, path: str, **filters) -> None:
        """JSON lines in key order and a manifest, one sorted file set under path."""
        lines = ledger.export_lines(self.ledger, **filters)
        lines.orderBy(F.col("logical_key").asc_nulls_last(), "seq").select("line").write.mode("overwrite").text(path)

    # the plane

    def submit_proposal(self, **fields) -> str:
        """The proposal's fingerprint; the same content is written once."""
        names = ("kind", "submitted_by", "factor_name", "experiment_fingerprint", "summary", "detail")
        row = self.spark.createDataFrame([tuple(fields.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
        checked = plane.with_fingerprint(row).select("*", plane.proposal_error().alias("error")).first()
        if checked.error:
            raise ValueError(checked.error)
        key = f"proposal:{checked.fingerprint}"
        last = self.get_as_of(key, 2**63 - 1)
        if last is None or bytes(last.payload) != checked.payload.encode():
            self.put_versioned(key, checked.payload.encode(), f"agent:{checked.submitted_by}")
        return checked.fingerprint

    # evidence and jobs

    def put_if_changed(self, key: str, payload: bytes, source: str = "engine") -> bool:
        """Whether a version was written: content equal to the latest one is not written again."""
        last = self.get_as_of(key, 2**63 - 1)
        if last is not None and bytes(last.payload) == payload:
            return False
        self.put_versioned(key, payload, source)
        return True

    def _names(self, prefix: str, as_of_nanos: int) -> DataFrame:
        """(name, body) of the latest versions under a prefix as of an instant."""
        seen = ledger.as_of(self.ledger.where(F.col("logical_key").startswith(prefix)), as_of_nanos)
        return seen.select(F.expr(f"substring(logical_key, {len(prefix) + 1})").alias("name"), F.col("payload").cast("string").alias("body"))

    def admit_factor(self, factor: str, experiment: str, as_of_nanos: int = 2**63 - 1) -> bool:
        """Write the edge from a factor to its experiment, unless a suspect duplicate of the factor was admitted by then."""
        if not factor or not experiment:
            raise ValueError("factor and experiment must not be empty")
        edges = self._names("factor:similarity:", as_of_nanos).select(F.from_json("body", EDGE_SCHEMA).alias("e")).select("e.*")
        own = edges.where((F.col("factor_a") == factor) | (F.col("factor_b") == factor))
        admitted = self._names(keys.EDGE_PREFIXES["factor"], as_of_nanos).select(F.from_json("body", "`from` string").alias("e")).select(F.col("e.from").alias("factor"))
        rival = plane.suspect_duplicates(own, admitted).where(F.col("factor") == factor).first()
        if rival:
            raise SuspectDuplicateError(f"{factor} is a suspect duplicate of {rival.rival}")
        return self.link("factor", factor, experiment)

    def link(self, family: str, src: str, dst: str) -> bool:
        """Write an edge of the evidence graph once: factor, experiment, strategy or paper to what follows it."""
        return self.put_if_changed(f"{keys.EDGE_PREFIXES[family]}{src}:{dst}", json.dumps({"from": src, "to": dst}, separators=(",", ":"), ensure_ascii=False).encode())

    def register(self, family: str, name: str, **fields: str) -> bool:
        """Write an object of the evidence graph once: a strategy, paper or review with its fields."""
        body = {"id" if family == "review" else "name": name, **fields}
        return self.put_if_changed(keys.OBJECT_PREFIXES[family] + name, json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode())

    def apply_spec(self, spec: dict) -> int:
        """Check a job spec and write it as a new version; returns its seq."""
        row = self.spark.createDataFrame([tuple(spec.get(f) for f in jobs.SPEC_FIELDS)], jobs.SPEC_SCHEMA)
        error = row.select(jobs.spec_error().alias("e")).first().e
        if error:
            raise ValueError(error)
        payload = row.select(jobs.spec_json().alias("j")).first().j
        return self.put_versioned(keys.JOB_PREFIXES["spec"] + spec["name"], payload.encode(), "engine")

    # files

    def compact(self) -> None:
        """Rewrite the change log to the newest change of every key, tombstones kept, sorted by key."""
        path = f"{self.folder}/changes"
        new = f"{path}.{uuid.uuid4().hex}"
        best = self.changes.groupBy("key").agg(F.max_by(F.struct("value", "op", "arrival", "tag"), "arrival").alias("c")).select("key", "c.*")
        best.sort("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(new)
        tables.replace_table(self.spark, path, new)

    def drop_delivered(self, cursor: str) -> int:
        """Delete the files of the change log that hold nothing at or after the delivered cursor."""
        files = kv.reclaimable(tables.file_catalog(self.spark, f"{self.folder}/changes"), cursor)
        return tables.delete_files(self.spark, [r.path for r in files.select("path").toLocalIterator()])

    def build_context(self, contracts: DataFrame, redlines: DataFrame, as_of_nanos: int) -> DataFrame:
        """The context bundle from experiments and strategies in the ledger as of an instant."""
        seen = ledger.as_of(self.ledger, as_of_nanos).select("logical_key", F.col("payload").cast("string").alias("p"))
        v = F.from_json("p", "verdict struct<fingerprint:string,hypothesis_summary:string,level:string,as_of:string,test_index:int>")["verdict"]
        experiments = seen.where(F.col("logical_key").startswith(keys.OBJECT_PREFIXES["experiment"])).select(
            v["fingerprint"].alias("experiment_fingerprint"), v["hypothesis_summary"].alias("hypothesis_summary"), v["level"].alias("level"), v["as_of"].alias("as_of"), v["test_index"].alias("test_index")
        )
        prefix = keys.OBJECT_PREFIXES["strategy"]
        strategies = seen.where(F.col("logical_key").startswith(prefix)).select(F.expr(f"substring(logical_key, {len(prefix) + 1})").alias("name"), F.col("p").alias("body"))
        return plane.context_bundle(contracts, experiments, strategies, redlines, as_of_nanos)
