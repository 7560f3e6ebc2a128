"""The job loop over an engine's ledger: recover, tick, run.

The jobs are a catalog of a handful of specs, so what a tick decides is collected; statuses and
events are versions of job:status:NAME and job:events:NAME.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, scalars
from ..schema import EVENT_SCHEMA, STATUS_SCHEMA
from . import jobs, ledger

#: Runs a spec (a dict) and returns its exit code and message.
Executor = Callable[[dict], tuple[int, str]]


class Controller:
    """Reconciles specs with what ran; executor, alert and clock (nanoseconds) are given."""

    def __init__(self, engine, executor: Executor, alert: Callable[[str, str], None] = lambda name, message: None, clock: Callable[[], int] = time.time_ns):
        self.engine, self.executor, self.alert, self.clock = engine, executor, alert, clock

    def _latest(self, family: str, schema) -> DataFrame:
        prefix = keys.JOB_PREFIXES[family]
        own = ledger.latest(self.engine.ledger.where(F.col("logical_key").startswith(prefix)))
        text = F.col("payload").cast("string")
        return own.select(F.expr(f"substring(logical_key, {len(prefix) + 1})").alias("name"), "seq", text.alias("body"), F.from_json(text, schema).alias("r"))

    def _put(self, family: str, name: str, body: dict) -> None:
        self.engine.put_if_changed(keys.JOB_PREFIXES[family] + name, json.dumps(body, separators=(",", ":")).encode())

    def specs(self) -> DataFrame:
        """Latest specs with their fingerprint and the slot of now."""
        rows = self._latest("spec", jobs.SPEC_SCHEMA).select("body", "r.*").withColumn("spec_fingerprint", F.sha2("body", 256))
        every = F.greatest(F.col("schedule_interval_seconds"), F.lit(1)) * scalars.NANOS
        plain = F.floor(F.lit(self.clock()).cast("decimal(38,0)") / every).cast("long")
        slot = plain
        for s in [r.schedule for r in rows.select("schedule").where("schedule <> ''").distinct().collect()]:
            hour, minute, zone = scalars.parse_schedule(s)
            for step in [r.s for r in rows.where(F.col("schedule") == s).select(F.col("schedule_interval_seconds").alias("s")).distinct().collect()]:
                anchored = scalars.anchored_slot(F.lit(self.clock()), step, zone, hour, minute)
                slot = F.when((F.col("schedule") == s) & (F.col("schedule_interval_seconds") == step), anchored).otherwise(slot)
        return rows.withColumn("slot", slot)

    def statuses(self) -> DataFrame:
        return self._latest("status", STATUS_SCHEMA).select("name", "r.*")

    def recover(self) -> list[str]:
        """Names of the hanging statuses that took what the newest event of their slot and spec says."""
        prefix = keys.JOB_PREFIXES["events"]
        text = F.from_json(F.col("payload").cast("string"), EVENT_SCHEMA)
        events = self.engine.ledger.where(F.col("logical_key").startswith(prefix)).select(F.expr(f"substring(logical_key, {len(prefix) + 1})").alias("name"), "seq", text.alias("r")).select("name", "seq", "r.*")
        before = {r.name: r.phase for r in self.statuses().collect()}
        changed = [r for r in jobs.recover(self.statuses(), events).collect() if before[r.name] != r.phase]
        for r in changed:
            self._put("status", r.name, {k: v for k, v in r.asDict().items() if k != "name"})
        return sorted(r.name for r in changed)

    def tick(self) -> dict[str, str]:
        """What was done for each spec, in the order of names: done, backoff, wait, or the outcome of a run."""
        specs = self.specs().drop("body").persist()
        plan = jobs.decide(specs, self.statuses(), self.clock()).join(specs, "name").orderBy("name").collect()
        specs.unpersist()
        seen = {}
        for r in plan:
            track = {"slot": r.slot, "spec_fingerprint": r.spec_fingerprint}
            seen[r.name] = r.action
            if r.action == "wait":
                self._put("status", r.name, {"phase": "pending", **track, "attempt": 0, "last_verdict": "waiting_on_deps"})
            elif r.action == "run":
                seen[r.name] = self._run(r, track)
        return seen

    def _run(self, r, track: dict) -> str:
        self._put("status", r.name, {"phase": "running", **track, "attempt": r.attempt, "last_attempt_time": self.clock()})
        code, message = self.executor(r.asDict())
        outcome = "succeeded" if code == 0 else "alert" if r.attempt > (r.max_retries or 0) else "failed"
        event = {"outcome": outcome, **track, "attempt": r.attempt, "exit_code": code, "message": message, "write_nanos": self.clock()}
        self._put("events", r.name, event)
        phase = {"succeeded": "succeeded", "alert": "alerting", "failed": "failed"}[outcome]
        status = {"phase": phase, **track, "attempt": r.attempt, "last_attempt_time": event["write_nanos"], "last_exit_code": code, "last_verdict": outcome}
        self._put("status", r.name, status | {"message": message or ("ok" if code == 0 else "")})
        if outcome == "alert":
            self.alert(r.name, message)
        return outcome

    def run(self, period: float, stop: Callable[[], bool], on_tick: Callable[[dict], None] = lambda seen: None, sleep: Callable[[float], None] = time.sleep) -> None:
        """Recover once, then tick each period until stop says so."""
        self.recover()
        while not stop():
            on_tick(self.tick())
            sleep(period)
