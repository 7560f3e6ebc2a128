"""Delivery sinks for foreachBatch, and what guards them: retries, breakers, routing."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Send = Callable[[DataFrame, int], None]


def json_each_row(batch: DataFrame) -> DataFrame:
    """(line): each value, a JSON object, with its key as _key; other values are refused."""
    parsed = F.from_json("value", "map<string,variant>")
    checked = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("key")))).otherwise(parsed)
    own = F.map_filter(checked, lambda k, _: k != "_key")
    body = F.to_json(own)
    key = F.to_json(F.struct(F.col("key").alias("_key")))  # {"_key":"..."}
    rest = F.when(F.size(own) == 0, "}").otherwise(F.concat(F.lit(","), F.substring(body, F.lit(2), F.char_length(body) - 1)))
    return batch.select(F.concat(F.substring(key, F.lit(1), F.char_length(key) - 1), rest).alias("line"))


def base64_rows(batch: DataFrame) -> DataFrame:
    """(line): key and value in base64, as JSON."""
    return batch.select(F.to_json(F.struct(F.base64(F.col("key").cast("binary")).alias("Key"), F.base64(F.col("value").cast("binary")).alias("Value"))).alias("line"))


class JsonLinesSink:
    """Appends batches as JSON lines under path; a batch is a folder of its own, so a repeat replaces it."""

    def __init__(self, path: str, shape: Callable[[DataFrame], DataFrame] = base64_rows):
        self.path, self.shape = path, shape

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.shape(batch).write.mode("overwrite").text(f"{self.path}/batch={batch_id:012d}")


class IdempotentSink(JsonLinesSink):
    """Skips keys at or below the highest one delivered, so restarts from an older cursor add nothing."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, None
        try:
            done = spark.read.parquet(f"{self.path}/_marks").where(F.col("batch_id") != batch_id)
            mark = done.agg(F.max("key").alias("k")).first().k
        except Exception as error:  # nothing was delivered yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh = batch if mark is None else batch.where(F.col("key") > mark)
        super().__call__(fresh, batch_id)
        top = fresh.agg(F.max("key").alias("key")).where("key is not null").withColumn("batch_id", F.lit(batch_id))
        top.write.mode("overwrite").parquet(f"{self.path}/_marks/b={batch_id}")


class HttpRowsSink:
    """Posts batches as JSON lines to a URL, from the tasks that hold the rows, ``block`` lines a request.

    A request that fails or answers with another status than 2xx is tried ``attempts`` times, with
    pauses that double; then the batch fails and the cursor stays, so rows arrive at least once.
    """

    def __init__(self, url: str, *, attempts: int = 3, backoff: float = 0.1, timeout: float = 10.0, block: int = 10_000):
        self.url, self.attempts, self.backoff, self.timeout, self.block = url, attempts, backoff, timeout, block
        self.error: str | None = None

    @property
    def healthy(self) -> bool:
        return self.error is None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        url, attempts, backoff, timeout, block = self.url, self.attempts, self.backoff, self.timeout, self.block

        def post(body: bytes) -> None:
            for turn in range(attempts):
                try:
                    request = urllib.request.Request(url, body, {"Content-Type": "application/x-ndjson"}, method="POST")
                    with urllib.request.urlopen(request, timeout=timeout):
                        return
                except OSError:  # refused, timed out, or a status that is no success
                    if turn + 1 == attempts:
                        raise
                    time.sleep(backoff * 2**turn)

        def send(batches):
            for rows in batches:
                lines = rows.column(0).to_pylist()
                for at in range(0, len(lines), block):
                    post(("\n".join(lines[at : at + block]) + "\n").encode())
                yield pa.RecordBatch.from_pydict({"n": [len(lines)]})

        try:
            json_each_row(batch).mapInArrow(send, "n long").agg(F.sum("n")).collect()
        except Exception as error:
            self.error = str(error)
            raise
        self.error = None


def with_retry(send: Send, attempts: int = 3, backoff: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> Send:
    """send, tried up to ``attempts`` times with a fixed pause."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for left in reversed(range(attempts)):
            try:
                return send(batch, batch_id)
            except Exception:
                if not left:
                    raise
                sleep(backoff)

    return run


@dataclass
class Breaker:
    """Closed until ``limit`` failures in a row; then open for ``cooldown`` seconds; then one trial."""

    limit: int = 3
    cooldown: float = 5.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None
    trial: bool = False

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.cooldown else "open"

    def allow(self) -> bool:
        state = self.state
        if state == "half-open":
            if self.trial:
                return False
            self.trial = True
        return state != "open"

    def success(self) -> None:
        self.failures, self.opened, self.trial = 0, None, False

    def failure(self) -> None:
        self.failures += 1
        if self.trial or self.failures >= self.limit:
            self.opened, self.trial = self.clock(), False


@dataclass
class Router:
    """Sends a batch to one healthy sink: in turn, or the first in order of priority; the next one if it fails."""

    sinks: dict[str, Send]
    priority: bool = False
    breakers: dict[str, Breaker] = field(default_factory=dict)
    turn: int = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> str:
        names = list(self.sinks)
        if not self.priority:
            names = names[self.turn % len(names) :] + names[: self.turn % len(names)]
            self.turn += 1
        last: Exception | None = None
        for name in names:
            breaker = self.breakers.setdefault(name, Breaker())
            if not breaker.allow():
                continue
            try:
                self.sinks[name](batch, batch_id)
            except Exception as error:
                breaker.failure()
                last = error
                continue
            breaker.success()
            return name
        raise RuntimeError("no sink took the batch") from last
