"""Planted problems: each is found at about its rate, clean runs give nothing, causes are found, tested, reviewed and labelled."""

import json

import pytest

from spanloom import cli
from spanloom.errors import SpanloomError
from spanloom.testing.fakes import FakeEmbedder, FakeReplayer, FakeTextClient, ScriptedIO
from spanloom.testing.planted import TRUTH, planted_spans
from spanloom.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    out = Workspace(spark, str(tmp_path_factory.mktemp("planted") / "ws"), embedder=FakeEmbedder.semantic(), llm=FakeTextClient())
    assert out.ingest(planted_spans(spark, 300)) == 300 * 7 + 60
    return out


def test_planted(ws):
    found = ws.analyze("song_ideas")
    assert not found.notes and found.spent["calls"] >= 1
    for metric, rate in TRUTH.values():
        mine = [f for f in found if f.metric == metric]
        assert mine, metric
        if rate is not None:
            assert mine[0].value == pytest.approx(rate, abs=0.05 + 0.3 * rate), metric
    slower = [f for f in found if f.metric == "latency_ms_median"]
    assert [(f.scope["prompt_version"], f.details["before"], f.severity) for f in slower] == [("4", "3", "high")]
    assert {f.metric for f in found} <= {m for m, _ in TRUTH.values()} | {"error_rate"}
    pattern = next(f for f in found if f.metric == "largest_cluster_share")
    assert pattern.detector == "homogeneity" and pattern.severity == "high" and pattern.evidence[0] == pattern.details["cluster_id"] and "lighthouse" in pattern.title
    assert pattern.details["closeness"][0]["section"] == "example" and pattern.baseline == 0 and pattern.details["measures"]["distinct_rate"] == 1


def test_again(ws):
    """The same runs, the same findings under the same ids; nothing is embedded or described twice."""
    first = {f.key: (f.id, f.value) for f in ws.findings()}
    ws.embedder.model_id, known = ws.embedder.model_id, ws.table("embeddings").count()
    assert {f.key: (f.id, f.value) for f in ws.analyze("song_ideas")} == first
    assert ws.table("embeddings").count() == known and ws.analyze("song_ideas", stages=("describe",)).spent["calls"] == 0


def test_cause_and_tests(ws):
    f = next(f for f in ws.findings() if f.metric == "largest_cluster_share")
    done = ws.explain(f.id)
    assert (
        done.cause["kind"], done.cause["target"], done.cause["status"]
    ) == ("prompt_section", "example", "suspected") and done.cause["effect"] > 0.7 and "example" in done.cause["hypothesis"]
    with pytest.raises(SpanloomError, match="replayer"):
        ws.test(f.id)
    ws.replayer = FakeReplayer(
        lambda span, sections: f"something new about {span['span_id']}" if sections.get("example", "x") is None else "an old lighthouse keeper counts passing ships through winter fog"
    )
    good = ws.test(f.id, samples=30)
    assert good.cause["status"] == "confirmed" and good.test["after"] == 0 and "-" in good.fix["diff"] and good.test["samples"] == 30
    ws.replayer = FakeReplayer(lambda span, sections: "an old lighthouse keeper counts passing ships through winter fog")
    assert ws.test(f.id, samples=10).cause["status"] == "refuted"
    assert {r["span_id"] for r in ws.traces(f.evidence[1:3])} >= set(f.evidence[1:3])
    html = ws.report("html")
    assert "lighthouse" in html and f.evidence[1] in html and "confirmed" not in ws.finding(f.id).cause["status"]
    plain = next(x for x in ws.findings() if x.metric == "zero_score_rate")
    assert ws.explain(plain.id).cause["kind"] == "none"


def test_review_and_labels(ws):
    ws.llm = FakeTextClient(
        label=lambda said: {"label": "ships" if "lighthouse" in said else "other"},
        taxonomy={"labels": [{"label": "ships", "definition": "about ships"}, {"label": "boats", "definition": "too"}]}
    )
    io = ScriptedIO(
        lambda question, choices: {
            "ships: about ships": "keep", "boats: too": "merge ships", "another label (NAME: definition), or nothing": ""
        }.get(question, "")
    )
    with pytest.raises(SpanloomError, match="no taxonomy"):
        ws.label_all("song_ideas")
    taxonomy = ws.review("song_ideas", io, n=12)
    assert set(taxonomy.labels) == {"ships"} and len(io.shown) == 12
    more = iter(["other: the rest", ""])
    io = ScriptedIO(
        lambda question, choices: next(more) if question.startswith("another") else (
            "keep" if ": " in question else ("ships" if "lighthouse" in io.shown[-1] else "other")
        )
    )
    ws.llm.answers["taxonomy"] = {"labels": [{"label": "ships", "definition": "about ships"}]}
    taxonomy = ws.review("song_ideas", io, n=12)
    assert len(taxonomy.human) == 12 and {*taxonomy.human.values()} == {"ships", "other"}
    done = ws.label_all("song_ideas", confirm=lambda n, tokens: n == 300 and tokens > 0)
    assert sum(done.counts.values()) == 300 and done.agreement == 1 and done.counts["ships"] == pytest.approx(120, abs=25)
    assert ws.label_all("song_ideas", confirm=lambda n, tokens: False).notes == ["not confirmed"]


def test_command_line(ws, capsys):
    base = [ws.path, "--embedder", "spanloom.testing.fakes:FakeEmbedder.semantic"]
    assert cli.main([*base, "analyze", "--workflow", "song_ideas", "--stages", "stats"]) == 0
    assert "F-00" in capsys.readouterr().out
    f = next(f for f in ws.findings() if f.metric == "largest_cluster_share")
    assert cli.main([*base, "explain", f.id]) == 0 and "prompt_section example" in capsys.readouterr().out
    assert cli.main([*base, "--replayer", "spanloom.testing.fakes:FakeReplayer", "test", f.id, "--samples", "5"]) == 0 and "refuted" in capsys.readouterr().out
    assert cli.main(
        [ws.path, "set-status", f.id, "dismissed", "--note", "known"]
    ) == 0 and cli.main([ws.path, "findings", "--status", "dismissed"]) == 0 and f.id in capsys.readouterr().out
    assert cli.main([ws.path, "report", "--kind", "json"]) == 0 and f.id not in [x["id"] for x in json.loads(capsys.readouterr().out)["findings"]]
    assert cli.main([ws.path, "query", "SELECT count(*) AS n FROM calls"]) == 0 and "n\n" in capsys.readouterr().out
    assert cli.main([ws.path, "set-status", "F-9999", "fixed"]) == 1 and "no finding" in capsys.readouterr().err
    assert cli.main([ws.path, "--llm", "no.module:x", "findings"]) == 1
    with pytest.raises(SystemExit) as bad:
        cli.main([ws.path, "report", "--kind", "pdf"])
    assert bad.value.code == 2


def test_clean(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"), embedder=FakeEmbedder.semantic())
    ws.ingest(planted_spans(spark, 300, ()))
    assert list(ws.analyze("song_ideas")) == [] and not ws.notes
