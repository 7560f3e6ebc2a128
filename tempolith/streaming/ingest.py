"""Ingest and delivery as streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import keys
from ..operators import clean, ledger


def monotonic_stream(records: DataFrame) -> DataFrame:
    """records (arrival, key, value) whose key's time exceeds every earlier accepted one of its device.

    The state is the last accepted time of each device, kept without bound as lateness has none;
    records whose keys hold no time pass.
    """
    device, ts = keys.device_and_ts("key")
    keyed = records.select(F.coalesce(device, F.concat(F.lit("="), "key")).alias("device"), "arrival", "key", "value", ts.alias("ts"))

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for t in rows["ts"]:
            good = pd.isna(t) or last is None or int(t) > last
            keep.append(good)
            if good and not pd.isna(t):
                last = int(t)
        if last is not None:
            state.update((last,))
        yield rows[keep][["arrival", "key", "value"]]

    return keyed.groupBy("device").applyInPandasWithState(step, "arrival long, key string, value string", "last long", "append", GroupStateTimeout.NoTimeout)


def ack_report(results: DataFrame, mode: str, most: int = 1000) -> DataFrame | None:
    """What is acknowledged of results: each row, count-based windows, or nothing."""
    if mode == "every":
        return results.select("conn", "corr_id", "arrival", "result", "reason")
    if mode == "window":
        return clean.ack_windows(results, most)
    if mode == "none":
        return None
    raise ValueError(f"unknown ack mode {mode!r}")


def ingest(
    records: DataFrame, contracts: DataFrame, path: str, checkpoint: str, *, source: str = "stream", trigger: dict | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, **options
) -> StreamingQuery:
    """Clean a stream (arrival, key, value, write_nanos) and append it to a ledger at path.

    Each micro-batch is a folder of its own; seqs continue those of earlier batches, so a repeated
    batch writes the same rows again.  Dropped records go to {path}_dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = clean.clean(batch.select("arrival", "write_nanos", "key", "value"), contracts, **options).persist()
        before = None
        if batch_id:
            try:
                before = spark.read.parquet(path).where(F.col("batch") < batch_id)
            except Exception as error:  # no earlier batch had rows
                if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                    raise
        good = done.where("result = 'accept'").select(
            F.col("key").alias("logical_key"), F.col("value").cast("binary").alias("payload"), F.lit(source).alias("source"), F.lit(1).alias("schema_ver"), "write_nanos", "arrival"
        )
        ledger.assign_versions(good, before).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        done.where("result = 'drop'").drop("value").write.mode("overwrite").parquet(f"{path}_dropped/batch={batch_id}")
        if on_batch:
            on_batch(done, batch_id)
        done.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deliver(records: DataFrame, send: Callable[[DataFrame, int], object], checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Deliver business records (key, value) to a sink; the cursor moves only after a batch was taken."""
    business = records.where(~F.col("key").startswith(keys.OFFSET_PREFIX))

    def run(batch: DataFrame, batch_id: int) -> None:
        send(batch, batch_id)

    return business.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema: str, *, max_files: int = 0, max_bytes: str = "") -> DataFrame:
    """A stream of Parquet files whose batches hold at most so many files or bytes (0 and '' have no bound)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


class Health(StreamingQueryListener):
    """What the streaming queries of a session are doing: (state, rows of the last batch) by the name or id of a query."""

    def __init__(self):
        self.seen: dict[str, tuple[str, int]] = {}

    def onQueryStarted(self, event):
        self.seen[event.name or str(event.id)] = ("running", 0)

    def onQueryProgress(self, event):
        self.seen[event.progress.name or str(event.progress.id)] = ("running", event.progress.numInputRows)

    def onQueryIdle(self, event):
        self.seen[str(event.id)] = ("idle", 0)

    def onQueryTerminated(self, event):
        self.seen[str(event.id)] = ("failed" if event.exception else "ended", 0)

    @property
    def healthy(self) -> bool:
        return all(state != "failed" for state, _ in self.seen.values())
