"""Proposals, similarity, evidence, jobs, registry import and the facade."""

import json

import pytest
from pyspark.sql import functions as F

from tempolith.engine import Engine, RoleError, SuspectDuplicateError
from tempolith.operators import jobs, metrics, plane
from tempolith.sources import tables


def test_similarity_gate(spark):
    a = [3.0, 5.5, 1.25, 7.0, 2.0, 6.5, 4.0]
    b = [x * 2 + d for x, d in zip(a, (0.1, -0.2, 0.0, 0.3, -0.1, 0.2, 0.1))]
    rows = [("a", i, x) for i, x in enumerate(a)] + [("b", i, x) for i, x in enumerate(b)] + [("flat", i, 1.0) for i in range(7)] + [("short", 0, 1.0)]
    edges = plane.correlations(spark.createDataFrame(rows, "factor string, at int, value double"))
    (edge,) = edges.collect()
    assert (edge.factor_a, edge.factor_b, edge.suspect) == ("a", "b", True) and edge.correlation > 0.7
    gate = plane.suspect_duplicates(edges, spark.createDataFrame([("a",)], "factor string")).collect()
    assert [(r.factor, r.rival) for r in gate] == [("b", "a")]


def graph(spark, *, whole=True):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    o = lambda *rows: spark.createDataFrame(list(rows), "name string, body string")
    edges = {"factor": e(("amihud", "x1")), "experiment": e(("x1", "c1")) if whole else e(("-", "-")), "strategy": e(("c1", "p1")), "paper": e(("p1", "r1"))}
    objects = {"experiment": o(("x1", "pass_raw")), "strategy": o(("c1", "paper")), "paper": o(("p1", "running")), "review": o(("r1", "ok"))}
    return spark.createDataFrame([("amihud",), ("unknown",)], "factor string"), edges, objects


def test_evidence(spark):
    chain = {r.factor: r.experiments for r in plane.evidence_chain(*graph(spark)).collect()}
    assert chain["unknown"] == [] and chain["amihud"][0].strategies[0].papers[0].reviews[0].review_body == "ok"
    bad = {(r.factor, r.level, r.problem) for r in plane.evidence_degraded(*graph(spark, whole=False)).collect()}
    assert bad == {("unknown", "factor", "no_edge"), ("amihud", "experiment", "no_edge")}


def test_decisions(spark):
    specs = spark.createDataFrame([(n, 1, "fp", deps, 60) for n, deps in [("ok", []), ("late", []), ("hang", []), ("blocked", ["none"]), ("fresh", ["ok"])]], "name string, slot bigint, spec_fingerprint string, depends_on array<string>, retry_backoff_seconds int")
    old = [("ok", 1, "fp", "succeeded", 1, 0), ("late", 1, "fp", "failed", 1, 10**9), ("hang", 1, "fp", "running", 2, 0)]
    statuses = spark.createDataFrame(old, "name string, slot bigint, spec_fingerprint string, phase string, attempt int, last_attempt_time bigint")
    got = {r.name: (r.action, r.attempt) for r in jobs.decide(specs, statuses, 2 * 10**9).collect()}
    assert got == {"ok": ("done", None), "late": ("backoff", None), "hang": ("run", 2), "blocked": ("wait", None), "fresh": ("run", 1)}
    assert jobs.decide(specs, statuses, 62 * 10**9).where("name = 'late'").first().attempt == 2


def test_recover_takes_the_event(spark):
    statuses = spark.createDataFrame([("j", "running", 1, "fp", 1, 0, 0, "", "")], "name string, phase string, slot bigint, spec_fingerprint string, attempt int, last_attempt_time bigint, last_exit_code int, last_verdict string, message string")
    events = spark.createDataFrame([("j", 1, "fp", 5, "succeeded", 1, 0, "", 77)], "name string, slot bigint, spec_fingerprint string, seq bigint, outcome string, attempt int, exit_code int, message string, write_nanos bigint")
    row = jobs.recover(statuses, events).first()
    assert (row.phase, row.message, row.last_attempt_time) == ("succeeded", "ok", 77)


def test_legal_phases(spark):
    assert len(jobs.PHASE_EDGES) == 8
    rows = [("s", i, p) for i, p in enumerate(["hypothesis", "gate", "candidate", "live", "retired", "gate"])]
    got = jobs.phase_violations(spark.createDataFrame(rows, "name string, seq int, phase string")).collect()
    assert [(r.from_phase, r.to_phase) for r in got] == [("candidate", "live"), ("retired", "gate")]


def test_spec_fingerprint_ignores_dependency_order(spark):
    schema = "name string, command array<string>, dir string, env map<string,string>, depends_on array<string>, schedule_interval_seconds bigint, max_retries int, retry_backoff_seconds bigint, schedule string"
    rows = [("j", ["/bin/true"], "", None, d, 60, 1, 1, "") for d in (["a", "b"], ["b", "a"])]
    df = spark.createDataFrame(rows, schema)
    assert df.select(jobs.spec_fingerprint()).distinct().count() == 1 and df.where(jobs.spec_error().isNotNull()).count() == 0


def test_registry_import(spark):
    lines = spark.createDataFrame([('{"verdict":{"fingerprint":"fp-one","kind":"gate"}}',), ("",), ("{broken",), ('{"verdict":{}}',)], "value string")
    none = spark.createDataFrame([], "logical_key string, payload binary")
    classified, writes = tables.import_registry(lines, none)
    assert tables.import_summary(classified).first().asDict() == {"total": 3, "imported": 1, "unchanged": 0, "errors": 2}
    again, _ = tables.import_registry(lines, writes)
    assert tables.import_summary(again).first().unchanged == 1


def test_registry_lines_in_order(spark, tmp_path):
    one, two = '{"verdict":{"fingerprint":"k1","kind":"x"}}', '{"verdict":{"fingerprint":"k1","kind":"y"}}'
    (tmp_path / "r.jsonl").write_text("\n".join([one, one, "", two, "nope", '{"verdict":{"fingerprint":""}}', one]) + "\n")
    e = Engine(spark, str(tmp_path / "data"))
    from tempolith.__main__ import run

    run(e, "import-registry", [str(tmp_path / "r.jsonl")])
    seen = e.list_versions("strategy:index:k1").collect()
    assert [bytes(r.payload).decode() for r in seen] == [one, two, one]
    classified, _ = tables.import_registry(tables.numbered_lines(spark, str(tmp_path / "r.jsonl")), spark.createDataFrame([], "logical_key string, payload binary"))
    assert [(r.line, r.reason) for r in classified.where("outcome = 'error'").orderBy("line").collect()] == [(5, "not a JSON object"), (6, "verdict.fingerprint is empty")]
    assert [r.outcome for r in classified.orderBy("line").collect()] == ["imported", "unchanged", "imported", "error", "error", "imported"]


def test_evidence_writes_and_gate(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    edge = json.dumps({"factor_a": "f1", "factor_b": "f2", "correlation": 0.9, "suspect": True})
    e.put_versioned("factor:similarity:f1|f2", edge.encode(), "engine")
    assert e.admit_factor("f1", "x1") and not e.admit_factor("f1", "x1")
    with pytest.raises(SuspectDuplicateError):
        e.admit_factor("f2", "x2")
    assert e.link("experiment", "x1", "s1") and e.register("strategy", "s1", phase="gate") and not e.register("strategy", "s1", phase="gate")
    assert e.list_versions("evidence:factor:f1:x1").count() == 1 and e.list_versions("strategy:obj:s1").count() == 1


def test_job_loop(spark, tmp_path):
    from tempolith.operators.control import Controller

    e, now, codes, alerts = Engine(spark, str(tmp_path)), [10**18], {"a": [1, 1], "b": [0]}, []
    spec = {"command": ["/bin/true"], "schedule_interval_seconds": 3600, "max_retries": 1, "retry_backoff_seconds": 60}
    e.apply_spec({"name": "a", **spec})
    e.apply_spec({"name": "b", **spec, "depends_on": ["c"]})
    e.apply_spec({"name": "c", **spec})
    with pytest.raises(ValueError):
        e.apply_spec({"name": "", **spec})
    control = Controller(e, lambda s: (codes.get(s["name"], [0]).pop(0) if codes.get(s["name"]) else 0, ""), lambda n, m: alerts.append(n), lambda: now[0])
    assert control.tick() == {"a": "failed", "b": "wait", "c": "succeeded"}
    assert control.tick() == {"a": "backoff", "b": "succeeded", "c": "done"}
    now[0] += 61 * 10**9
    assert control.tick() == {"a": "alert", "b": "done", "c": "done"} and alerts == ["a"]
    control._put("status", "c", {"phase": "running", "slot": control.specs().where("name = 'c'").first().slot, "spec_fingerprint": control.specs().where("name = 'c'").first().spec_fingerprint, "attempt": 1})
    assert control.recover() == ["c"] and control.statuses().where("name = 'c'").first().phase == "succeeded"


def test_files_compact_and_retention(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.put_many([("a", "1"), ("b", "1")])
    e.put("a", "2")
    e.delete("b")
    e.put("z", "9")
    before = [(r.key, r.value) for r in e.scan().collect()]
    catalog = tables.file_catalog(spark, f"{tmp_path}/changes").collect()
    assert sum(r.rows for r in catalog) == 5 and min(r.min_key for r in catalog) == "a" and max(r.max_key for r in catalog) == "z"
    e.compact()
    assert [(r.key, r.value) for r in e.scan().collect()] == before == [("a", "2"), ("z", "9")] and e.changes.count() == 3
    e.put("zz", "1")
    assert e.drop_delivered("zz") >= 1 and [r.key for r in e.scan().collect()] == ["zz"]


def test_shell_goes_on_after_errors(spark, tmp_path, capsys):
    from tempolith.__main__ import shell

    shell(Engine(spark, str(tmp_path)), ["put k 'a b'", "", "get k", "nonsense", "scan", "get-as-of k x", "help", "exit", "get k"])
    out = capsys.readouterr().out
    assert out.count("a b") == 1 and "cannot run 'nonsense'" in out and "error:" in out and "import-registry file" in out


def test_contract_files(spark, tmp_path):
    good = {"type_id": 1, "name": "quote", "key_prefix": "quote:", "required_fields": ["code"], "time_semantics": {"kind": "none"}}
    (tmp_path / "q.schema.json").write_text(json.dumps(good))
    df, digest = tables.load_contracts(spark, str(tmp_path))
    assert df.first().name == "quote" and len(digest) == 64
    (tmp_path / "bad.schema.json").write_text(json.dumps(good | {"surprise": 1}))
    with pytest.raises(ValueError):
        tables.load_contracts(spark, str(tmp_path))


def test_ewma_and_counters(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 20, 30])], "k string, o int, v double")
    assert metrics.ewma(df, "k", "o", "v", 0.5).first().ewma == 22.5
    seen_df, seen = metrics.counted(df, "c", rows=F.count("*"))
    seen_df.collect()
    assert seen.get["rows"] == 3


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    key, base = "quote:2026-08-17:510300", 10**18
    assert [e.put_versioned(key, f"v{i}".encode(), "job-a", 2, base + i * 10**9) for i in range(3)] == [1, 2, 3]
    assert bytes(e.get_as_of(key, base + 5 * 10**8).payload) == b"v0" and bytes(e.get_as_of(key, base + 25 * 10**8).payload) == b"v2" and e.get_as_of(key, base - 1) is None
    r = e.replay_fingerprint("quote:")
    assert r.key_count == 1 and r.mismatches == [] and e.list_versions(key).count() == 3
    with pytest.raises(RoleError):
        e.put_versioned("quote:x", b"1", "agent:bot")
    fp = e.submit_proposal(kind="factor", submitted_by="bot", factor_name="f", summary="a < b & c", detail='{"x":1}')
    assert e.submit_proposal(kind="factor", submitted_by="bot", factor_name="f", summary="a < b & c", detail='{"x":1}') == fp
    stored = bytes(e.get_as_of(f"proposal:{fp}", 2**62).payload).decode()
    assert "\\u003c" in stored and json.loads(stored)["summary"] == "a < b & c" and e.list_versions(f"proposal:{fp}").count() == 1
    with pytest.raises(ValueError):
        e.submit_proposal(kind="other", submitted_by="b", summary="s")
    e.put_many([("imu:dev0:100", '{"az":9.8}'), ("imu:dev0:150", '{"az":9.95}'), ("imu:dev0:200", '{"az":10.2}'), ("imu:dev1:150", '{"az":11}')])
    e.delete("imu:dev0:200")
    assert [r.key for r in e.scan("imu:dev0:100", "imu:dev0:299", "az", ">", "9.9").collect()] == ["imu:dev0:150"]
    assert e.get("imu:dev0:100") == '{"az":9.8}' and e.get(key) == "v2" and e.get("none") is None
    assert len(list(e.list_writes_all(2))) == 4
    e.export_writes(str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 5 and sum('"_manifest":true' in x for x in lines) == 1


def test_cli(spark, tmp_path, capsys):
    from tempolith.__main__ import run

    e = Engine(spark, str(tmp_path))
    assert run(e, "put", ["a", "1"]) == 0 and run(e, "get", ["a"]) == 0 and run(e, "get", ["b"]) == 1
    run(e, "put-versioned", ["k", "x", "job"])
    run(e, "fingerprint", [])
    out = capsys.readouterr().out
    assert "1\n" in out and "keys=1" in out
