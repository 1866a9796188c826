"""Sources, derivation, detectors, findings and the workspace on planted spans; statistics against plain Python."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import findings as fs
from spanloom.errors import SourceError, SpanloomError
from spanloom.functions import scalars, stats
from spanloom.operators import detectors, vectors
from spanloom.plans.derive import depths, derive, step_ancestors
from spanloom.plans.normalize import normalize
from spanloom.schemas import SPAN
from spanloom.sources import registry
from spanloom.sources.registry import open_source
from spanloom.streaming.ingest import ingest_stream, rates_by_window
from spanloom.testing.contracts import check_embedder, check_replayer, check_rerunner, check_source, check_text_client
from spanloom.testing.fakes import FakeEmbedder, FakeHistory, FakeReplayer, FakeSource, FakeStepRerunner, FakeTextClient
from spanloom.testing.writers import write_otlp, write_runs, write_store
from spanloom.workspace import Workspace


def span(i, name="hone.models.chat", run=0, status="ok", parent=None, message=None, trace=None, **attributes):
    base = {"hone.flow.workflow": "w", "hone.run_id": f"r{run}", "hone.step": "ideas"} | {k.replace("__", "."): v for k, v in attributes.items()}
    return {
        "trace_id": trace or f"t{run}", "span_id": f"s{i}", "parent_span_id": parent, "name": name,
        "start_time": f"2026-01-01T00:{i // 60 % 60:02}:{i % 60:02}.000Z",
        "end_time": f"2026-01-01T00:{i // 60 % 60:02}:{i % 60:02}.500Z", "status": {"code": status, "message": message},
        "attributes": base, "events": [{"name": "retry"}] if i % 4 == 0 else []
    }


def planted():
    out = []
    for i in range(80):
        out.append(
            span(
                i, run=i // 2, status="error" if i % 10 == 0 else "ok",
                message="HTTP 400: not supported" if i % 10 == 0 else None, gen_ai__request__model="lab/alpha-7b",
                gen_ai__response__finish_reasons='["length"]' if i % 8 == 1 else '["stop"]',
                gen_ai__output__messages=json.dumps([{"role": "assistant", "content": f"text {i % 5}"}])
            )
        )
    out += [span(100 + i, run=i, gen_ai__request__model="lab/alpha:judge", hone__scorer="judge") for i in range(5)]
    out += [span(200 + i, name="hone.flow.step", run=i, hone__flow__status="done") for i in range(4)] + [span(300, name="hone.flow.run")]
    return out


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "spans.jsonl").write_text("".join(json.dumps(s) + "\n" for s in planted()) + '{"trace_id": "torn')
    return tmp_path


def test_workspace(spark, folder):
    ws = Workspace(spark, str(folder / "ws"))
    assert ws.ingest(f"jsonl:{folder}/in") == 90
    assert ws.ingest(f"jsonl:{folder}/in") == 0
    assert {n: ws.table(n).count() for n in ("calls", "steps", "outputs", "run_calls")} == {"calls": 85, "steps": 4, "outputs": 80, "run_calls": 1}
    by = {f.metric: f for f in ws.analyze("w", stages=("stats",))}
    assert not ws.notes
    assert by["error_rate"].affected == 8 and by["error_rate"].total == 80 and by["error_rate"].severity == "medium"
    assert by["retry_rate"].affected >= 20 and by["truncation_rate"].affected == 10
    assert by["capability_error_rate"].severity == "high" and by["same_family_judge_share"].scope["scorer"] == "judge"
    report = ws.analyze("w")
    same = {f.key: f.id for f in report}
    assert same == {f.key: f.id for f in by.values()} | same and len(same) == len(ws.findings()) and report.notes == ["no embedder: outputs were not analyzed"]
    one = by["truncation_rate"]
    assert len(one.evidence) == one.affected == ws.affected(one.id).count() and {r["span_id"] for r in ws.traces(one.evidence)} >= set(one.evidence)
    assert one.evidence[0] in ws.report("html") and one.title in ws.report("text")
    ws.set_status(one.id, "dismissed", "known")
    assert ws.finding(one.id).note == "known" and [f.id for f in ws.findings("dismissed")] == [one.id]
    assert one.id not in {f.id for f in fs.shown(ws.findings())} and one.title not in ws.report("html")
    assert ws.query("SELECT count(*) AS n FROM calls WHERE status = :s", s="error").first().n == 8
    assert json.loads(ws.report("json"))


def test_stream(spark, folder):
    ws = Workspace(spark, str(folder / "ws2"))
    (folder / "in" / "spans.jsonl").write_text("".join(json.dumps(s) + "\n" for s in planted()))
    for expected in (90, 93):
        ingest_stream(ws, str(folder / "in"), str(folder / "cp")).awaitTermination()
        assert ws.spans().count() == expected
        late = [span(400 + i, run=1, gen_ai__request__model="m") for i in range(3)] + planted()[:2]
        (folder / "in" / "late.jsonl").write_text("".join(json.dumps(s) + "\n" for s in late) + "no json\n")
    assert [r.value for r in spark.read.text(str(folder / "ws2" / "rejected" / "*")).collect()] == ["no json"]


def test_windowed_rates_of_a_stream(spark, tmp_path):
    rows = [{"start_time": f"2026-01-01T0{h}:30:00Z", "step": "a", "status": "error" if h else "ok"} for h in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    calls = spark.readStream.schema("start_time timestamp, step string, status string").json(str(tmp_path / "in"))
    done = rates_by_window(calls).writeStream.format("memory").queryName("rates").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted((r.total, r.hits) for r in spark.table("rates").collect()) == [(1, 0), (1, 1), (1, 1)]


def test_sources(spark, tmp_path):
    value = lambda k, v: {"key": k, "value": v}
    doc = {
        "resourceSpans": [
            {
                "resource": {"attributes": [value("service.name", {"stringValue": "svc"})]},
                "scopeSpans": [
                    {
                        "spans": [
                            {
                                "traceId": "AB", "spanId": "CD", "name": "x", "kind": 3,
                                "startTimeUnixNano": "1700000000123999999",
                                "attributes": [value("gen_ai.request.model", {"stringValue": "m"}), value("n", {"intValue": "5"})],
                                "status": {"code": 2}
                            }
                        ]
                    }
                ]
            }
        ]
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(doc).replace("CD", "EF") + "\n" + json.dumps(doc).replace("CD", "12"))
    rows = {r.span_id: r for r in normalize(open_source(spark, f"otlp:{tmp_path}")).collect()}
    assert set(rows) == {"cd", "ef", "12"} and rows["cd"].kind == "client" and rows["cd"].status.code == "error" and rows["cd"].attributes == {
        "gen_ai.request.model": "m", "n": "5"
    } and rows["cd"].start_time.microsecond == 123999
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "flow.json").write_text(
        json.dumps(
            {
                "data": [
                    {
                        "id": "o1", "traceId": "t", "type": "GENERATION", "startTime": "2026-01-01T00:00:00Z", "model": "m",
                        "promptVersion": 3, "level": "ERROR", "usageDetails": {"input": 7}
                    }
                ]
            }
        )
    )
    call = derive(normalize(open_source(spark, f"langfuse:{tmp_path}/runs/flow.json")))["calls"].first()
    assert (call.model, call.template_version, call.status, call.input_tokens, call.workflow) == ("m", "3", "error", 7, "flow")
    with pytest.raises(SourceError):
        open_source(spark, "nothing:here")
    bad = spark.createDataFrame([("t", None)], "trace_id string, span_id string").selectExpr(
        "trace_id", "span_id", "cast(null as string) parent_span_id", "'n' name", "cast(null as string) kind",
        "current_timestamp() start_time", "current_timestamp() end_time", "named_struct('code', '2', 'message', '') status",
        "cast(null as map<string,string>) attributes", "null events", "null resource", "null links"
    )
    with pytest.raises(Exception, match="malformed span"):
        normalize(bad).collect()


def test_depth_of_chains_and_cycles(spark):
    rows = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(600)] + [
        ("c", "a", "b"), ("c", "b", "a"), ("c", "d", "a"), ("c", "self", "self"), ("o", "x", "gone")
    ]
    got = {(r.trace_id, r.span_id): r.depth for r in depths(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")).collect()}
    assert all(got["t", f"s{i}"] == i for i in range(600)) and got["o", "x"] == 0
    assert (got["c", "a"], got["c", "b"], got["c", "d"], got["c", "self"]) == (1, 1, 2, 0)


def test_step_above_an_output(spark):
    rows = [("t", "step", None, True)] + [("t", f"s{i}", f"s{i - 1}" if i else "step", False) for i in range(300)] + [
        ("t", "inner", "s9", True), ("t", "x", "inner", False), ("t", "y", "gone", False), ("c", "a", "b", False),
        ("c", "b", "a", False)
    ]
    got = {
        r.span_id: r.step_span_id for r in step_ancestors(
            spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, is_step boolean")
        ).collect()
    }
    assert all(got[f"s{i}"] == "step" for i in range(300)) and got["x"] == "inner" and got["inner"] == "step" and not got.keys() & {"y", "a", "b", "step"}


def test_bad_lines(spark, tmp_path):
    """A torn last line waits for the rest; any other bad line is an error, wherever it stands."""
    good = [json.dumps(s) for s in planted()[:3]]
    (tmp_path / "torn.jsonl").write_text("\n".join([*good, '{"trace_id": "t']))
    (tmp_path / "whole.jsonl").write_text("\n".join(json.dumps(s) for s in planted()[3:5]))
    assert normalize(open_source(spark, f"jsonl:{tmp_path}")).count() == 5
    for bad in ("\n".join([good[0], "no json", good[1]]) + "\n", "\n".join([*good, "no json"]) + "\n"):
        (tmp_path / "torn.jsonl").write_text(bad)
        with pytest.raises(Exception, match="no JSON in a line"):
            normalize(open_source(spark, f"jsonl:{tmp_path}")).collect()
    (tmp_path / "torn.jsonl").write_text(json.dumps(planted()[0] | {"attributes": {"hone.schema_version": "2"}}) + "\n")
    with pytest.raises(Exception, match="schema version"):
        normalize(open_source(spark, f"jsonl:{tmp_path}")).collect()
    with pytest.raises(SourceError, match="nothing at"):
        open_source(spark, f"jsonl:{tmp_path}/not-there")


def test_only_changed_files_are_read(spark, folder):
    ws = Workspace(spark, str(folder / "ws3"))
    lines = [json.dumps(s) + "\n" for s in planted()]
    (folder / "in" / "spans.jsonl").write_text("".join(lines[:40]))
    assert ws.ingest(f"jsonl:{folder}/in") == 40 and ws.ingest(f"jsonl:{folder}/in") == 0
    (folder / "in" / "spans.jsonl").write_text("".join(lines[:40]) + lines[40][:30])
    assert ws.ingest(f"jsonl:{folder}/in") == 0
    (folder / "in" / "spans.jsonl").write_text("".join(lines))
    assert ws.ingest(f"jsonl:{folder}/in") == 50 and ws.ingested[-1].added == 50
    assert ws.table("calls").count() == 85
    before = sorted(map(repr, ws.table("calls").collect()))
    ws.compact()
    assert sorted(map(repr, ws.table("calls").collect())) == before and len(ws._manifest()["generations"]) == 1


def test_the_first_copy_wins(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    rows = [span(1, status="ok"), span(1, status="error") | {"start_time": "2026-01-01T00:00:05.000Z"}, span(2), span(2, run=9)]
    assert ws.ingest(rows) == 2
    assert ws.ingest([span(1, status="error") | {"start_time": "2025-01-01T00:00:00.000Z"}, span(3), span(3)]) == 1
    assert {(r.span_id, r.status.code, r.trace_id) for r in ws.spans().collect()} == {("s1", "ok", "t0"), ("s2", "ok", "t0"), ("s3", "ok", "t0")}


def test_a_failed_write_leaves_the_workspace_as_it_was(spark, folder):
    ws = Workspace(spark, str(folder / "ws4"))
    ws.ingest(f"jsonl:{folder}/in")
    torn = [planted()[0] | {"span_id": "new", "name": None}]
    with pytest.raises(Exception, match="malformed"):
        ws.ingest(spark.createDataFrame([json.dumps(torn[0])], "string").select(F.from_json("value", SPAN).alias("s")).select("s.*"))
    assert ws.spans().count() == 90
    number, path = ws.docs.storage.numbered(ws.path, "manifest")[-1]
    with pytest.raises(SourceError, match="another writer"):
        ws.docs.storage.put(path, {})
    assert ws.table("calls").count() == 85


def test_custom_detectors_run(spark, folder):
    ws = Workspace(spark, str(folder / "ws5"))
    ws.ingest(f"jsonl:{folder}/in")

    @detectors.detector("quality")
    def texts_too_short(scope):
        n = scope.sql("SELECT span_id FROM outputs WHERE length(text) < 400 ORDER BY start_time").collect()
        return [
            fs.Finding(
                "", "", {"workflow": "w"}, "short", len(n) / 80, affected=len(n), total=80, evidence=[n[0].span_id],
                words=f"{len(n)} texts are too short"
            )
        ]

    @detectors.detector("cost", name="rows")
    def of_rows(scope):
        return scope["calls"].groupBy("workflow").agg(F.count(F.lit(1)).alias("total"), F.lit("n_calls").alias("metric"), F.lit(85.0).alias("value"))

    @detectors.detector()
    def broken(scope):
        raise ValueError("no")

    try:
        with pytest.raises(SpanloomError, match="registered already"):
            detectors.detector()(texts_too_short)
        report = ws.analyze("w", stages=("stats",))
        found = {f.detector: f for f in report}
        assert found["texts_too_short"].title == "80 texts are too short" and found["texts_too_short"].category == "quality" and found["rows"].category == "cost"
        assert any("broken: ValueError: no" in n for n in report.notes)
    finally:
        for name in ("texts_too_short", "rows", "broken"):
            detectors.REGISTRY.pop(name, None)


def scored(values, *, scorer="s", **more):
    at = dt.datetime(2026, 1, 1)
    base = {"reason": None, "confidence": None, "error": None} | more
    return [
        (f"x{i}", f"r{i}", "w", "score", f"c{i}", scorer, v, base["reason"], base["confidence"], base["error"], at + dt.timedelta(seconds=i)) for i,
        v in enumerate(values)
    ]


def test_floor_scores(spark):
    schema = "span_id string, run_id string, workflow string, kind string, candidate_id string, scorer string, value double, reason string, confidence double, error string, start_time timestamp"
    calls = spark.createDataFrame([("w", "s", "failed")] * 4, "workflow string, scorer string, structured_path string")

    def found(rows):
        t = {"selections": spark.createDataFrame(rows, schema), "calls": calls}
        return {r.metric: r for r in detectors.zero_scores(t).rows.collect()}

    five = [0.0] * 12 + [0.25] * 2 + [0.5] * 8 + [0.75] * 12 + [1.0] * 6
    said = found(scored(five, reason="too plain", confidence=0.9, error=""))
    assert set(said) == {"floor_score_rate"} and said["floor_score_rate"].value == 0.3 and said["floor_score_rate"].severity == "high" and said["floor_score_rate"].sample_reasons == ["too plain"] * 3
    lost = found(scored(five + [None] * 40, reason="Error: bad answer", confidence=0.9))
    assert set(lost) == {"zero_score_rate"} and lost["zero_score_rate"].value == 12 / 80 and lost["zero_score_rate"].failed_judge_calls == 4
    # zeros beside as many scores at the next level are no spike
    assert not found(scored([0.0] * 10 + [0.25] * 90, reason="plain", confidence=1.0))


def test_every_format_reads_alike(spark, tmp_path):
    """The same spans from a store, run folders, documents of the protocol and an object: the same tables."""
    rows = [r | {"trace_id": f"{int(r['trace_id'][1:]):032x}", "span_id": f"{int(r['span_id'][1:]):016x}"} for r in planted()]
    write_store(rows, tmp_path / "store" / "a" / "spans.db", large=60)
    write_runs(rows, tmp_path / "runs")
    write_store(rows[:10], tmp_path / "mixed" / "x" / "spans.db")
    write_runs(rows[10:], tmp_path / "mixed")
    write_otlp(rows, tmp_path / "one" / "spans.json")
    write_otlp(rows, tmp_path / "lines" / "spans.json", by_line=True)
    want = None
    for source in (
        f"store:{tmp_path}/store", f"runs:{tmp_path}/runs", f"runs:{tmp_path}/mixed", f"otlp:{tmp_path}/one",
        f"otlp:{tmp_path}/lines/*.json", FakeSource(rows)
    ):
        got = {n: sorted(map(repr, df.collect())) for n, df in derive(normalize(open_source(spark, source))).items()}
        want = want or got
        assert got == want and len(got["calls"]) == 85, source
    since = dt.datetime(2026, 1, 1, 0, 1, tzinfo=dt.UTC)
    assert open_source(spark, f"store:{tmp_path}/store", since=since).count() == open_source(spark, f"otlp:{tmp_path}/one", since=since).count() > 0


def test_flow_source(spark, tmp_path):
    history = FakeHistory()
    step = lambda n, statuses, **more: {
        "step": n, "item": "0", "kind": "step", "status": "done", "attempt": len(statuses),
        "attempts": [{"status": s} for s in statuses], "reviews": [], "started_at": "2026-01-01T00:00:00+00:00", "duration_ms": 5
    } | more
    for i in range(10):
        statuses = ["rejected", "done"] if i < 6 else ["done"]
        gate = {
            "step": "gate", "item": "0", "kind": "gate", "status": "done", "attempt": 1, "attempts": [],
            "reviews": [{"decision": "rejected", "actor_kind": "automated" if i == 0 else None}]
        }
        history.add(f"r{i}", [step("ideas", statuses), gate], [span(1000 + i, name="hone.flow.step", run=i, hone__item="0")], seed=i)
    registry.FLOW_HISTORY.append(lambda storage: history)
    try:
        ws = Workspace(spark, str(tmp_path / "flow"))
        assert ws.ingest("flow:memory/w") == 10
        found = {f.metric: f for f in ws.analyze("w", stages=("stats",))}["revision_rate"]
        assert (found.affected, found.total, found.severity) == (5, 10, "high") and found.evidence == [f"s100{i}" for i in range(1, 6)]
        history.fork("r9", "r10", ["ideas"], "2026-02-01T00:00:00+00:00")
        history.add("r1", [step("ideas", ["done"])], updated_at="2026-02-01T00:00:00+00:00")
        ws.ingest("flow:memory/w")
        records = ws.table("flow_steps")
        assert records.count() == 21 and records.filter("run_id = 'r1'").count() == 1 and records.filter("fork_of = 'r9'").count() == 2
    finally:
        registry.FLOW_HISTORY.clear()
    with pytest.raises(SourceError, match="no flow runner"):
        ws.ingest("flow:memory/w")


def test_ranks_of_hot_groups(spark):
    r = np.random.default_rng(3)
    data = [("a", float(x)) for x in r.normal(size=500).round(1)] + [("b", float(x)) for x in r.lognormal(3, 2, 301)] + [("c", 0.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    want = {g: [v for k, v in data if k == g and v is not None] for g in "abc"}
    got = {x.g: x for x in stats.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert [got[g].low, got[g].mid, got[g].top] == pytest.approx(np.percentile(values, [10, 50, 100]).tolist())
    near = {x.g: x.mid for x in stats.quantiles(df, ["g"], "v", {"mid": 0.5}, accuracy=1000).collect()}
    assert near["b"] == pytest.approx(got["b"].mid, rel=0.1)
    ranks = {(x.g, x.v): x._rank for x in stats.ranked(df, ["g"], "v").collect()}
    for g, values in want.items():
        assert all(ranks[g, v] == sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values)


def test_text_of_messages(spark):
    cases = {
        "plain": "plain",
        '["not messages"]': "",
        "[broken": "[broken",
        '{"a": 1}': "",
        '[{"role": "user", "content": "a"}, {"content": "{\\"b\\": 1}"}, {"content": "[1, 2]"}]': 'a\n{"b": 1}\n[1, 2]',
        '[{"content": ["s", {"type": "text", "text": "t"}, {"type": "image", "text": "no"}, {"content": "u"}, 5]}]': "s\nt\nu",
        '[{"parts": [{"type": "text", "content": "p"}]}, {"content": "c", "parts": ["q"]}, {"content": {"x": 1}}, {"content": null}]': "p\nc\nq",
        "[]": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r.m: r.t for r in df.select("m", scalars.messages_text(F.col("m")).alias("t")).collect()} == cases
    got = spark.sql("SELECT '[1, {\"a\": 2}]' AS a, '{\"k\": [1]}' AS b, 'x' AS c, CAST(NULL AS STRING) AS d, '2026-01-01T02:00:00.1209+02:00' AS t")
    r = got.select(
        *[scalars.json_list(F.col(c)).alias(f"l{c}") for c in "abcd"],
        *[scalars.json_map(F.col(c)).alias(f"m{c}") for c in "abcd"], scalars.canonical_time(F.col("t")).alias("t")
    ).first()
    assert (r.la, r.lb, r.lc, r.ld) == (
        ["1", '{"a":2}'], [], [], []
    ) and (r.ma, r.mb, r.mc, r.md) == ({}, {"k": "[1]"}, {}, {}) and r.t == "2026-01-01T00:00:00.120Z"
    with pytest.raises(Exception, match="no ISO time"):
        got.select(scalars.canonical_time(F.col("c"))).collect()


def test_statistics(spark):
    r = random.Random(2)
    data = [(r.randint(0, 9), r.randint(10, 30), r.randint(0, 9), r.randint(10, 30)) for _ in range(20)] + [(0, 0, 1, 5)]
    df = spark.createDataFrame(data, "a int, n int, b int, m int")
    low, high = stats.wilson(F.col("a"), F.col("n"))
    out = df.select("*", low.alias("low"), high.alias("high"), stats.two_proportion_z(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("z")).collect()
    for x in out:
        if x.n:
            p, z = x.a / x.n, 1.96
            mid, half = p + z * z / (2 * x.n), z * math.sqrt(p * (1 - p) / x.n + z * z / (4 * x.n**2))
            assert x.low == pytest.approx(max(0, (mid - half) / (1 + z * z / x.n))) and x.high == pytest.approx(min(1, (mid + half) / (1 + z * z / x.n)))
            q = (x.a + x.b) / (x.n + x.m)
            se = math.sqrt(q * (1 - q) * (1 / x.n + 1 / x.m))
            assert x.z == pytest.approx((x.a / x.n - x.b / x.m) / se if se else 0)
        else:
            assert (x.low, x.high, x.z) == (0, 1, 0)
    assert 0 <= stats.p_of_z(3) <= stats.p_of_z(0) == 1


def test_leader_clusters(spark):
    r = random.Random(1)
    def near(axis):
        v = [0.02 * r.random() for _ in range(8)]
        v[axis] = 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]
    data = [("g", f"a{i}", near(0)) for i in range(30)] + [("g", f"b{i}", near(1)) for i in range(12)] + [
        ("g", f"x{i}", near(2 + i)) for i in range(3)
    ] + [("h", "one", near(0))]
    got = {
        x.span: x.cluster for x in vectors.leader_clusters(
            spark.createDataFrame(data, "step string, span string, v array<double>"), ["step"], "span", "v"
        ).collect()
    }
    assert {got[f"a{i}"] for i in range(30)} == {0} and {got[f"b{i}"] for i in range(12)} == {1} and {got["x0"], got["x1"], got["one"]} == {-1}


def test_carry_over():
    make = lambda metric, seen="2": fs.Finding("d", "quality", {"workflow": "w"}, metric, 0.5, "high", 5, 10, last_seen=seen)
    first = fs.carry_over([make("a"), make("b")], [])
    first[0].status, first[0].fixed_at, first[1].cause = "fixed", "2", {"kind": "model"}
    again = {f.metric: f for f in fs.carry_over([make(first[0].metric, "3"), make(first[1].metric), make("c")], first)}
    assert again[first[0].metric].status == "regressed" and again[first[0].metric].id == first[0].id and again["c"].id == "F-0003" and len(again) == 3
    assert again[first[1].metric].cause == {"kind": "model"}
    assert [fs.pct(x) for x in (0.4, 0.004, 0, 1)] == ["40%", "0.4%", "0%", "100%"]
    assert make("a").impact == 0.5 * 3 and fs.Finding(
        "d", "cost", {}, "m", 1.0, "low", 1, 2
    ).impact == 0.5 * 0.8 and fs.Finding("d", "cost", {}, "m", 1.0).impact == 0


def test_contracts():
    check_source(FakeSource(planted()))
    for e in (FakeEmbedder(), FakeEmbedder.semantic()):
        check_embedder(e)
    check_text_client(FakeTextClient())
    check_replayer(FakeReplayer(), planted()[0])
    check_rerunner(FakeStepRerunner())
    with pytest.raises(AssertionError):
        check_embedder(type("Short", (), {"model_id": "m", "dimensions": 3, "embed": lambda self, texts, *, trace=None: [[1.0]] * len(texts)})())
    with pytest.raises(AssertionError, match="distinct"):
        check_source(FakeSource([planted()[0], planted()[0]]))


def test_leaders_against_the_plain_rule():
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(1, 60))
        v = r.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1)[:, None]
        links = v @ v.T >= 0.8
        free, expected = set(range(n)), []
        while len(expected) < 50:
            counts = {i: sum(links[i, j] for j in free) for i in sorted(free)}
            if not counts or max(counts.values()) < 5:
                break
            best = max(counts, key=lambda i: (counts[i], -i))
            expected.append(best)
            free -= set(np.flatnonzero(links[best]).tolist())
        assert vectors.leader_places(links, 5).tolist() == expected


def test_span_schema_is_read(spark):
    assert spark.createDataFrame([], SPAN).count() == 0


def test_span_store(spark, tmp_path):
    import sqlite3

    from spanloom.sources.sqlite import span_store

    (tmp_path / "a").mkdir()
    db = sqlite3.connect(tmp_path / "a" / "spans.db")
    db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
    db.execute(
        "CREATE TABLE spans (span_id TEXT PRIMARY KEY, trace_id TEXT, parent_span_id TEXT, name TEXT, kind TEXT, start_time TEXT, end_time TEXT, status_code TEXT, status_message TEXT, attributes TEXT, events TEXT, resource TEXT, links TEXT)"
    )
    db.execute("INSERT INTO meta VALUES ('schema_version', '1')")
    for i in range(3):
        db.execute(
            "INSERT INTO spans VALUES (?, 't', NULL, 'chat', 'client', ?, NULL, 'OK', NULL, ?, '[]', '{}', '[]')",
            (f"s{i}", f"2026-01-0{i + 1}T00:00:00.000Z", json.dumps({"gen_ai.request.model": f"m{i}"}))
        )
    db.execute("CREATE TABLE blobs (sha256 TEXT PRIMARY KEY, mime TEXT, size INTEGER, data BLOB NOT NULL)")
    db.execute(
        "INSERT INTO blobs VALUES ('aa', 'application/json', 0, ?), ('bb', 'text/plain', 0, ?)",
        (b'[{"role": "user", "content": "hi"}]', "h\u00e9".encode())
    )
    db.execute(
        "UPDATE spans SET attributes = ? WHERE span_id = 's2'",
        (json.dumps({"gen_ai.input.messages": {"$blob": "aa"}, "note": {"$blob": "bb"}, "lost": {"$blob": "cc"}}),)
    )
    db.commit()
    rows = {r.span_id: r for r in normalize(open_source(spark, f"store:{tmp_path}")).collect()}
    assert set(rows) == {"s0", "s1", "s2"} and rows["s1"].attributes == {"gen_ai.request.model": "m1"} and rows["s1"].status.code == "ok"
    blobs = rows["s2"].attributes
    assert json.loads(blobs["gen_ai.input.messages"]) == [{"role": "user", "content": "hi"}]
    assert blobs["note"] == "h\u00e9" and json.loads(blobs["lost"]) == {"$blob": "cc"}
    assert span_store(spark, str(tmp_path), since="2026-01-02T00:00:00.000Z").count() == 2
    db.execute("UPDATE meta SET value = '2'")
    db.commit()
    with pytest.raises(Exception, match="schema version"):
        span_store(spark, str(tmp_path)).collect()


def test_selections_are_derived(spark):
    rows = [
        span(
            1, name="hone.select.score", hone__select__scorer="s", hone__select__score__value="0.0",
            hone__select__score__reason='{"a": 1}', hone__select__candidate='{"id": "c1"}'
        ),
        span(2, name="hone.flow.gate", hone__flow__gate__decision="rejected", hone__flow__gate__actor_kind="automated"),
        span(3, name="hone.flow.gate"),
        span(
            4, name="hone.select.decision", hone__select__ranked='[{"id": "a", "total": 0.5}, {"id": "b", "total": 0.49}]',
            hone__select__fallback_used="true"
        ),
        span(5, name="other", gen_ai__system="p"),
    ]
    tables = derive(normalize(open_source(spark, spark.read.schema(SPAN).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])))))
    got = {r.kind: r for r in tables["selections"].collect()}
    assert set(got) == {"score", "human_gate", "decision"} and tables["steps"].count() == 1 and tables["calls"].count() == 0
    assert (got["score"].candidate_id, got["score"].value, got["score"].reason) == ("c1", 0.0, "(not captured, 8 chars)")
    assert (got["human_gate"].gate, got["human_gate"].decision, got["human_gate"].actor_kind) == ("ideas", "rejected", "automated")
    assert got["decision"].fallback_used == 1 and [x.total for x in got["decision"].ranked] == [0.5, 0.49]


def test_messages_of_older_traces(spark):
    def events(*named):
        return [{"name": n, "time": None, "attributes": a} for n, a in named]

    rows = [
        span(1) | {
            "events": events(
                ("gen_ai.system.message", {"content": "be brief"}), ("gen_ai.user.message", {"content": "hi"}), ("retry", {}),
                ("gen_ai.choice", {"message": '{"content": "yes"}'})
            )
        },
        span(2) | {
            "events": events(
                ("gen_ai.content.prompt", {"gen_ai.prompt": '[{"role": "user", "content": "p"}]'}),
                ("gen_ai.content.completion", {"gen_ai.completion": "c"}), ("gen_ai.choice", {"content": "d"})
            )
        },
        span(
            3, gen_ai__prompt__0__role="user", gen_ai__prompt__0__content="indexed"
        ) | {"events": events(("gen_ai.user.message", {"content": "event"}))},
        span(4, gen_ai__input__messages="kept") | {"events": events(("gen_ai.user.message", {"content": "event"}))}, span(5),
    ]
    raw = spark.read.schema(SPAN).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = {r.span_id: r.attributes for r in normalize(raw).collect()}
    read = lambda i, key: [tuple(m.values()) for m in json.loads(got[f"s{i}"][f"gen_ai.{key}.messages"])]
    assert read(1, "input") == [("system", "be brief"), ("user", "hi")] and read(1, "output") == [("assistant", "yes")]
    assert read(2, "input") == [("user", "p")] and read(2, "output") == [("assistant", "c"), ("assistant", "d")]
    assert read(3, "input") == [("user", "indexed")] and got["s4"]["gen_ai.input.messages"] == "kept"
    assert "gen_ai.input.messages" not in got["s5"]
