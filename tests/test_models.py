"""Budgets, questions, descriptions, replay tests and adapters with scripted models."""

import datetime as dt
import types

import pytest

from spanloom.errors import BudgetExceeded, SpanloomError
from spanloom.models.asking import Question, ask_each
from spanloom.models.budget import NO_LIMIT, Amount, Budget, budget_of
from spanloom.models.describe import cluster_samples, describe_clusters
from spanloom.models.openai import ChatClient, Embeddings
from spanloom.models.ports import TextClient
from spanloom.models.replay import calls_with, replay_test, section_text
from spanloom.models.review import Taxonomy
from spanloom.operators.rates import evidence
from spanloom.testing.contracts import check_embedder, check_text_client
from spanloom.testing.fakes import FakeTextClient


def test_budget():
    assert budget_of("$2").limit.usd == 2 and budget_of("5000 tokens").limit.tokens == 5000 and budget_of("40 calls").limit.calls == 40 and budget_of(1.5).limit.usd == 1.5 and budget_of(None).limit == NO_LIMIT
    for bad in ("many", "3 apples", "", "1.2.3"):
        with pytest.raises(SpanloomError):
            budget_of(bad)
    b = Budget(Amount(float("inf"), 100, float("inf")), usd_per_1k_tokens=1.0)
    with b.call(100) as usage:
        usage.append({"input_tokens": 40, "output_tokens": 20})
    assert (b.spent.calls, b.spent.tokens, b.spent.usd) == (1, 60, pytest.approx(0.06))
    with pytest.raises(BudgetExceeded), b.call(41):
        raise AssertionError("not reached")
    with b.call() as usage:
        usage.append({"cost_usd": 2})
    with pytest.raises(ValueError), b.call():
        raise ValueError
    assert b.spent.usd == pytest.approx(2.06) and b.spent.calls == 3 and budget_of(b) is b


def test_questions():
    q = Question("t", "i", {"a": {"type": "string"}})
    ask = lambda answer, budget=None: (lambda x: (dict(x.values), x.error))(q.put(FakeTextClient(t=answer), {}, budget or Budget()))
    assert isinstance(FakeTextClient(), TextClient)
    assert ask({"a": "x", "b": 1}) == ({"a": "x", "b": 1}, None)
    assert ask({"b": 1}) == ({}, "without a") and ask("text") == ({}, "no JSON object")
    b = Budget(Amount(1, float("inf"), float("inf")))
    assert ask(ValueError("down"), b) == ({}, "ValueError: down")
    with pytest.raises(BudgetExceeded):
        ask({"a": 1}, b)
    notes = []
    rows = list(ask_each(range(5), lambda r: {"n": r}, q, FakeTextClient(t=lambda said: {"a": 1} if "3" not in said else {}), budget_of("4 calls"), notes))
    assert [r for r, _ in rows] == [0, 1, 2] and notes[0] == "t: without a" and "stopped after 4" in notes[1]


def outputs(spark, n=61):
    at = dt.datetime(2026, 1, 1)
    rows = [
        (None if i % 3 == 0 else f"C-{i % 3 - 1}", f"s{i:03}", at + dt.timedelta(seconds=i), f"text {i} " + "x" * 700) for i in range(n)
    ] + [("C-1", "t", at, "more")]
    return spark.createDataFrame(rows, "cluster_id string, span_id string, start_time timestamp, text string")


def test_descriptions(spark):
    df = outputs(spark)
    for n in (1, 3, 7, 20, 100):
        rows = df.filter("cluster_id = 'C-1'").orderBy("start_time", "span_id").collect()
        want = {r.span_id for r in rows} if len(rows) <= n else {rows[i * len(rows) // n].span_id for i in range(n)}
        assert {r.span_id for r in evidence(df, ["cluster_id"], n, slices=7).filter("cluster_id = 'C-1'").collect()} == want
    assert {r.cluster_id: r.size for r in cluster_samples(df).collect()} == {"C-0": 20, "C-1": 21}
    model, notes, none = FakeTextClient(cluster_description={"description": "d", "in_common": "c"}), [], spark.createDataFrame([], "cluster_id string")
    assert describe_clusters(df, none, model, Budget(), notes) == [("C-1", "d", "c"), ("C-0", "d", "c")] and not notes
    assert len(model.calls[0]["messages"][1]["content"]) < 20 * 620 + 50
    assert len(describe_clusters(df, none, model, budget_of("1 calls"), notes)) == 1 and "stopped after 1" in notes[0]
    assert describe_clusters(df, spark.createDataFrame([("C-0",), ("C-1",)], "cluster_id string"), model, Budget(), notes) == []


def test_taxonomy():
    t = Taxonomy("w", {"a": "x", "b": "y", "c": "z"}, {"1": "a", "2": "b", "3": "c"})
    t.change("a", "rename", "d")
    t.change("b", "merge", "c")
    t.change("c", "keep")
    assert t.labels == {"c": "z", "d": "x"} and t.human == {"1": "d", "2": "c", "3": "c"}
    t.change("c", "drop")
    assert t.labels == {"d": "x"} and t.human == {"1": "d"}
    for bad in (("d", "eat", ""), ("x", "drop", ""), ("d", "merge", "x"), ("d", "rename", "")):
        with pytest.raises(SpanloomError):
            t.change(*bad)


class Shorter:
    """Replays end by length as often as ``left`` says."""

    def __init__(self, left=0.0):
        self.left, self.made = left, 0

    def replay_call(self, span, overrides, *, trace=None):
        self.made += 1
        if span["span_id"] == "broken":
            raise RuntimeError("gone")
        long = self.made % 10 < self.left * 10
        return {"attributes": {"gen_ai.response.finish_reasons": '["length"]' if long else '["stop"]'}}


def spans(n, share):
    return [
        {
            "span_id": f"s{i}", "attributes": {"gen_ai.response.finish_reasons": '["length"]' if i < n * share else '["stop"]'},
            "status": {"code": "ok"}
        } for i in range(n)
    ]


def test_replay():
    run = lambda rows, left=0.0, **more: replay_test(rows, "ex", "line one\nline two", "truncation_rate", Shorter(left), **more)
    good = run(spans(40, 0.5), quality=lambda s: 0.8)
    assert (good.status, good.best, good.before, good.after) == ("confirmed", "remove", 0.5, 0.0) and "-line one" in good.diff and good.cost["calls"] == 80
    assert run(spans(40, 0.5), quality=lambda s: 0.8 if "span_id" in s else 0.7).status == "suspected"
    assert run(spans(40, 0.0)).status == "refuted"
    assert run(spans(40, 0.05)).status == "suspected"
    cut = run(spans(40, 0.5), budget=budget_of("10 calls"))
    assert cut.variants[0]["replayed"] == 10 and len(cut.variants) == 1 and "stopped after 10 of 80" in cut.notes[0]
    failed = run([*spans(3, 1), {"span_id": "broken", "attributes": {}}])
    assert failed.variants[0]["replayed"] == 3 and "gone" in failed.notes[0]
    more = run(spans(20, 0.5), variants=4, client=FakeTextClient())
    assert [v["variant"] for v in more.variants] == ["remove", "rewrite 1", "rewrite 2", "counter-instruction"]
    assert replay_test(spans(3, 1), "ex", "", "median", Shorter()).notes == ["median can't be replayed"]


def test_calls_of_a_section(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(f"s{i}", at + dt.timedelta(seconds=i), [("ex", "1", 2, 5), ("role", "1", 0, 2)] if i % 2 else [], "abéd\U0001f600fg") for i in range(20)]
    df = spark.createDataFrame(rows, "span_id string, start_time timestamp, sections array<struct<id:string,version:string,start:int,end:int>>, prompt string")
    some = [r.span_id for r in calls_with(df, "ex", 4).collect()]
    assert len(some) == 4 and some == [r.span_id for r in calls_with(df.repartition(3), "ex", 4).collect()] and all(int(s[1:]) % 2 for s in some)
    assert calls_with(df, "none", 4).count() == 0 and section_text(df, "ex") == "éd\U0001f600" and section_text(df, "none") == ""


def test_model_server():
    ns = types.SimpleNamespace
    asked = []

    def create(**options):
        asked.append(options)
        text = '{"label": "a"}' if options["model"] == "m" else "no json"
        return ns(choices=[ns(message=ns(content=text))], usage=ns(prompt_tokens=3, completion_tokens=2))

    server = ns(
        chat=ns(completions=ns(create=create)),
        embeddings=ns(create=lambda model, input: ns(data=[ns(index=i, embedding=[float(len(t)), 1.0]) for i, t in reversed(list(enumerate(input)))]))
    )
    check_text_client(ChatClient("m", client=server))
    assert asked[0]["response_format"]["json_schema"]["name"] == "label"
    assert "no JSON" in ChatClient("x", client=server).complete(
        [{"role": "user", "content": "?"}], schema={"title": "t"}, trace={"traceparent": "00-1"}
    )["error"] and asked[-1]["extra_headers"] == {"traceparent": "00-1"}
    check_embedder(Embeddings("e", 2, client=server))
    with pytest.raises(SpanloomError, match="openai"):
        ChatClient("m")
