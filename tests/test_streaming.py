"""Streams: stateful monotonicity across restarts, ingest, delivery and what guards sinks."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tempolith.streaming import ingest, sinks


def feed(spark, folder, name, rows, schema="arrival long, key string, value string, write_nanos long"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def stream(spark, folder, schema="arrival long, key string, value string, write_nanos long"):
    return spark.readStream.schema(schema).json(str(folder))


def test_monotonic_state_survives_restart(spark, tmp_path):
    def run():
        q = ingest.monotonic_stream(stream(spark, tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()

    feed(spark, tmp_path / "in", "a", [(0, "imu:dev0:100", "", 0), (1, "imu:dev0:99", "", 0), (2, "imu:dev0:101", "", 0), (3, "imu:dev1:1", "", 0)])
    run()
    feed(spark, tmp_path / "in", "b", [(4, "imu:dev0:101", "", 0), (5, "imu:dev0:102", "", 0)])
    run()
    assert sorted(r.arrival for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 3, 5]


def test_ingest_and_delivery(spark, tmp_path):
    contracts = spark.createDataFrame([(1, "quote", "quote:")], "type_id int, name string, key_prefix string")
    good = dict(code="1", date="d", open=1, high=1, low=1, close=1, volume=1)
    for i in range(2):
        feed(spark, tmp_path / "in", str(i), [(10 * i, "quote:d:1", json.dumps(good), 5 + i), (10 * i + 1, "quote:d:2", "{}", 5)])
        ingest.ingest(stream(spark, tmp_path / "in"), contracts, str(tmp_path / "ledger"), str(tmp_path / "cp"), versioned=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "ledger")).orderBy("seq").collect()
    assert [(r.logical_key, r.seq) for r in rows] == [("quote:d:1", 1), ("quote:d:1", 2)]
    assert spark.read.parquet(str(tmp_path / "ledger_dropped")).count() == 2
    sink = sinks.JsonLinesSink(str(tmp_path / "sink"), sinks.json_each_row)
    records = stream(spark, tmp_path / "in").where("value <> '{}'").select("key", "value")
    for _ in range(2):  # the second finds nothing new
        ingest.deliver(records, sink, str(tmp_path / "dcp")).awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "sink")).collect()]
    assert len(lines) == 2 and all(x["_key"] == "quote:d:1" and x["code"] == "1" for x in lines)


def test_idempotent_sink_skips_what_was_delivered(spark, tmp_path):
    sink = sinks.IdempotentSink(str(tmp_path / "s"))
    frame = lambda *ks: spark.createDataFrame([(k, "v") for k in ks], "key string, value string")
    sink(frame("k1", "k2"), 0)
    sink(frame("k1", "k2", "k3"), 1)  # a restart from an older cursor
    sink(frame("k1", "k2", "k3"), 1)
    assert spark.read.text(str(tmp_path / "s/batch=*")).count() == 3


def test_json_rows_refuse_other_values(spark):
    with pytest.raises(Exception, match="not a JSON object"):
        sinks.json_each_row(spark.createDataFrame([("k", "nope")], "key string, value string")).collect()
    got = sinks.json_each_row(spark.createDataFrame([("k", '{"_key":"old","a":1}')], "key string, value string")).first().line
    assert json.loads(got) == {"_key": "k", "a": 1}


def test_breaker_router_and_retry():
    now, seen = [0.0], []

    def bad(batch, batch_id):
        raise OSError("down")

    breaker = sinks.Breaker(limit=2, cooldown=10, clock=lambda: now[0])
    router = sinks.Router({"a": bad, "b": lambda b, i: seen.append(i)}, priority=True, breakers={"a": breaker})
    assert [router(None, i) for i in range(3)] == ["b"] * 3 and seen == [0, 1, 2] and breaker.state == "open"
    now[0] = 11
    assert breaker.state == "half-open" and breaker.allow() and not breaker.allow()
    breaker.success()
    assert breaker.state == "closed"
    with pytest.raises(RuntimeError):
        sinks.Router({"a": bad})(None, 0)
    turns = sinks.Router({"a": lambda *_: None, "b": lambda *_: None})
    assert [turns(None, i) for i in range(3)] == ["a", "b", "a"]
    calls = []

    def flaky(batch, batch_id):
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    sinks.with_retry(flaky, 3, sleep=lambda _: None)(None, 0)
    assert len(calls) == 3


@pytest.fixture
def http_rows():
    """(url, bodies taken, statuses to answer with before 200)."""
    taken, statuses = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            status = statuses.pop(0) if statuses else 200
            if status == 200:
                taken.append(body)
            self.send_response(status)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", taken, statuses
    server.shutdown()
    server.server_close()


def test_http_rows_are_posted_and_retried(spark, http_rows):
    url, taken, statuses = http_rows
    frame = spark.createDataFrame([(f"k{i}", f'{{"a":{i}}}') for i in range(5)], "key string, value string").coalesce(1)
    sink = sinks.HttpRowsSink(url, attempts=3, backoff=0.01, block=2)
    statuses += [500, 503]
    sink(frame, 0)
    assert sink.healthy and [b.count("\n") for b in taken] == [2, 2, 1]
    assert [json.loads(x) for x in "".join(taken).splitlines()] == [{"_key": f"k{i}", "a": i} for i in range(5)]
    sink(frame.limit(0), 1)
    assert len(taken) == 3
    statuses += [500] * 100
    with pytest.raises(Exception, match="500"):
        sinks.HttpRowsSink(url, attempts=2, backoff=0.01)(frame, 2)
    statuses.clear()
    with pytest.raises(Exception, match="not a JSON object"):
        sink(spark.createDataFrame([("k", "nope")], "key string, value string"), 3)
    assert not sink.healthy and len(taken) == 3


def test_read_stream_bounds_its_batches(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(i, "k", "{}", 0)], "arrival long, key string, value string, write_nanos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    rows = ingest.read_stream(spark, str(tmp_path / "in"), "arrival long, key string, value string, write_nanos long", max_files=2)
    ingest.deliver(rows, lambda batch, _: sizes.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sizes == [2, 2, 1]


def test_health_tells_failed_queries(spark, tmp_path):
    health = ingest.Health()
    spark.streams.addListener(health)
    try:
        feed(spark, tmp_path / "in", "a", [(0, "k", "{}", 0)])
        ingest.deliver(stream(spark, tmp_path / "in"), lambda *_: None, str(tmp_path / "ok")).awaitTermination()

        def fail(batch, batch_id):
            raise OSError("down")

        def settled(count, state):
            until = time.monotonic() + 20
            while sum(s == state for s, _ in health.seen.values()) < count and time.monotonic() < until:
                time.sleep(0.05)
            return sum(s == state for s, _ in health.seen.values()) == count

        assert settled(1, "ended") and health.healthy
        with pytest.raises(Exception, match="down"):
            ingest.deliver(stream(spark, tmp_path / "in"), fail, str(tmp_path / "bad")).awaitTermination()
        assert settled(1, "failed") and not health.healthy
    finally:
        spark.streams.removeListener(health)
