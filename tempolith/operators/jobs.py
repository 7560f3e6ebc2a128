"""Job control over the ledger: specs, slots, dependencies, statuses and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NANOS, schedule_parts

#: Legal phase changes of a strategy.
PHASE_EDGES = (
    ("hypothesis", "gate"), ("gate", "candidate"), ("gate", "retired"), ("candidate", "paper"), ("candidate", "retired"), ("paper", "live"),
    ("paper", "retired"), ("live", "retired"),
)
TERMINAL = ("succeeded", "alerting")
SPEC_FIELDS = {
    "name": "string", "command": "array<string>", "dir": "string", "env": "map<string,string>", "depends_on": "array<string>", "schedule_interval_seconds": "bigint",
    "max_retries": "int", "retry_backoff_seconds": "bigint", "schedule": "string",
}
SPEC_SCHEMA = ", ".join(f"{k} {v}" for k, v in SPEC_FIELDS.items())


def spec_error() -> Column:
    """The first field that a job spec row gets wrong, null if none."""
    deps = F.coalesce("depends_on", F.array().cast("array<string>"))
    return (
        F.when(F.coalesce("name", F.lit("")) == "", "name")
        .when(F.coalesce(F.size("command"), F.lit(0)) <= 0, "command")
        .when(F.get("command", F.lit(0)) == "", "command[0]")
        .when(F.coalesce("schedule_interval_seconds", F.lit(0)) <= 0, "schedule_interval_seconds")
        .when((F.coalesce("schedule", F.lit("")) != "") & schedule_parts(F.col("schedule")).isNull(), "schedule")
        .when(F.coalesce("max_retries", F.lit(0)) < 0, "max_retries")
        .when(F.coalesce("retry_backoff_seconds", F.lit(0)) < 0, "retry_backoff_seconds")
        .when(F.exists(deps, lambda d: (d == "") | (d == F.col("name"))), "depends_on")
    )


def spec_json() -> Column:
    """The spec's JSON in fixed order, dependencies sorted."""
    body = F.struct(
        "name", "command", F.coalesce("dir", F.lit("")).alias("dir"), F.col("env"), F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"),
        F.col("schedule_interval_seconds").cast("long").alias("schedule_interval_seconds"), F.col("max_retries").cast("int").alias("max_retries"),
        F.col("retry_backoff_seconds").cast("long").alias("retry_backoff_seconds"),
        F.when(F.coalesce("schedule", F.lit("")) != "", F.col("schedule")).alias("schedule"),
    )
    return F.to_json(body)


def spec_fingerprint() -> Column:
    """SHA-256 of spec_json."""
    return F.sha2(spec_json(), 256)


def unmet_dependencies(specs: DataFrame, statuses: DataFrame) -> DataFrame:
    """(name, slot, dep): dependencies of specs (name, slot, depends_on) without a success in the slot."""
    deps = specs.select("name", "slot", F.explode("depends_on").alias("dep")).distinct()
    done = statuses.where("phase = 'succeeded'").select(F.col("name").alias("dep"), "slot")
    return deps.join(done, ["dep", "slot"], "left_anti").select("name", "slot", "dep")


def latest_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (name, slot, spec_fingerprint) wanted the event of the greatest seq."""
    found = events.join(wanted, ["name", "slot", "spec_fingerprint"], "left_semi")
    best = found.groupBy("name", "slot", "spec_fingerprint").agg(F.max_by(F.struct("seq", "outcome", "attempt", "exit_code", "message", "write_nanos"), "seq").alias("e"))
    return best.select("name", "slot", "spec_fingerprint", "e.*")


def status_of_event() -> dict[str, Column]:
    """The status columns that an event row implies."""
    ok = F.col("outcome") == "succeeded"
    return {
        "phase": F.when(ok, "succeeded").when(F.col("outcome") == "alert", "alerting").otherwise("failed"),
        "last_attempt_time": F.col("write_nanos"),
        "last_exit_code": F.col("exit_code"),
        "last_verdict": F.col("outcome"),
        "message": F.when(ok & (F.coalesce("message", F.lit("")) == ""), "ok").otherwise(F.col("message")),
    }


def recover(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """Statuses rebuilt from the ledger of events: those that hang in 'running' take what their event says."""
    newest = latest_events(events, statuses.select("name", "slot", "spec_fingerprint")).withColumns(status_of_event())
    e = newest.select("name", "slot", "spec_fingerprint", *[F.col(c).alias(f"_{c}") for c in ("phase", "attempt", "last_attempt_time", "last_exit_code", "last_verdict", "message")])
    hung = (F.col("phase") == "running") & F.col("_phase").isNotNull()
    joined = statuses.join(e, ["name", "slot", "spec_fingerprint"], "left")
    return joined.select(*[F.when(hung, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in statuses.columns])


def decide(specs: DataFrame, statuses: DataFrame, now_nanos: int) -> DataFrame:
    """(name, action, attempt): what a reconcile tick does for specs (name, slot, spec_fingerprint, depends_on, retry_backoff_seconds).

    Actions: done, backoff, wait (for dependencies), run.  A hanging attempt is repeated, a failed one counted on.
    """
    prev = statuses.select("name", *[F.col(c).alias(f"p_{c}") for c in ("slot", "spec_fingerprint", "phase", "attempt", "last_attempt_time")])
    unmet = unmet_dependencies(specs, statuses).select("name").distinct().withColumn("unmet", F.lit(True))
    j = specs.join(prev, "name", "left").join(unmet, "name", "left")
    same = F.coalesce((F.col("p_slot") == F.col("slot")) & (F.col("p_spec_fingerprint") == F.col("spec_fingerprint")), F.lit(False))
    early = now_nanos < F.col("p_last_attempt_time") + F.col("retry_backoff_seconds").cast("long") * NANOS
    action = (
        F.when(same & F.col("p_phase").isin(*TERMINAL), "done")
        .when(same & (F.col("p_phase") == "failed") & early, "backoff")
        .when((~same | (F.col("p_phase") == "pending")) & F.coalesce("unmet", F.lit(False)), "wait")
        .otherwise("run")
    )
    attempt = F.when(~same, 1).when(F.col("p_phase") == "running", F.col("p_attempt")).otherwise(F.col("p_attempt") + 1)
    return j.select("name", action.alias("action"), F.when(action == "run", attempt).alias("attempt"))


def phase_violations(phases: DataFrame) -> DataFrame:
    """(name, seq, from_phase, to_phase): changes in phases (name, seq, phase) that no legal edge allows."""
    before = F.lag("phase").over(Window.partitionBy("name").orderBy("seq"))
    moves = phases.select("name", "seq", before.alias("from_phase"), F.col("phase").alias("to_phase")).where("from_phase is not null")
    legal = F.concat_ws(">", "from_phase", "to_phase").isin(*[f"{a}>{b}" for a, b in PHASE_EDGES])
    return moves.where(~legal)
