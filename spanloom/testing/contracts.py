"""What an implementation of a port must do. Each check raises AssertionError with the rule that is broken."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from spanloom.models.ports import Embedder, Replayer, StepRerunner, TextClient, field

REQUIRED = ("trace_id", "span_id", "name", "start_time")


def _must(holds: bool, rule: str) -> None:
    if not holds:
        raise AssertionError(rule)


def check_source(source, *, least: int = 1) -> None:
    """Spans have ids, a name and a start; asking since the latest start gives no span before it; asking twice gives the same."""
    _must(isinstance(getattr(source, "name", None), str), "a source has a name")
    spans = list(source.spans())
    _must(len(spans) >= least, f"a source gives {least} spans")
    for s in spans:
        _must(all(s.get(k) for k in REQUIRED), f"a span has {', '.join(REQUIRED)}")
    ids = [s["span_id"] for s in spans]
    _must(len(set(ids)) == len(ids), "span ids are distinct")
    _must([s["span_id"] for s in source.spans()] == ids, "reading twice gives the same spans")
    latest = max(dt.datetime.fromisoformat(str(s["start_time"])) for s in spans)
    later = [s["span_id"] for s in source.spans(since=latest if latest.tzinfo else latest.replace(tzinfo=dt.UTC))]
    _must(set(later) <= set(ids), "since gives some of the spans")


def check_text_client(client) -> None:
    """With a schema, parsed is an object with its fields; usage counts tokens."""
    _must(isinstance(client, TextClient), "a text client has complete()")
    schema = {"title": "label", "type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}
    result = client.complete(
        [{"role": "system", "content": "Choose."}, {"role": "user", "content": '{"output": "x", "labels": {"a": "", "b": ""}}'}],
        schema=schema
    )
    parsed = field(result, "parsed")
    _must(isinstance(parsed, Mapping) and "label" in parsed, "parsed has the schema's fields")
    usage = field(result, "usage")
    _must(all(int(field(usage, k)) >= 0 for k in ("input_tokens", "output_tokens")), "usage has input_tokens and output_tokens")


def check_embedder(embedder) -> None:
    """A vector of the named size for each text, finite, in order, the same for the same text."""
    _must(isinstance(embedder, Embedder) and bool(embedder.model_id), "an embedder has model_id, dimensions and embed()")
    texts = ["a storm at sea", "a quiet harbour", "a storm at sea"]
    found = embedder.embed(texts)
    _must(len(found) == len(texts), "a vector for each text")
    _must(all(len(v) == embedder.dimensions and all(math.isfinite(x) for x in v) for v in found), "vectors are finite and of the named size")
    _must(list(found[0]) == list(found[2]) and list(found[0]) != list(found[1]), "equal texts have equal vectors, others others")
    _must(list(embedder.embed([])) == [], "no texts, no vectors")


def check_replayer(replayer, span: Mapping) -> None:
    """A replay of a call is a span with attributes; the call itself isn't changed."""
    _must(isinstance(replayer, Replayer), "a replayer has replay_call()")
    before = repr(span)
    new = replayer.replay_call(span, {"prompt.sections": {"example": None}})
    _must(isinstance(new, Mapping) and isinstance(new.get("attributes"), Mapping), "a replay has attributes")
    _must(repr(span) == before, "a replay leaves the call as it is")


def check_rerunner(rerunner) -> None:
    """A rerun gives the ids of the new runs."""
    _must(isinstance(rerunner, StepRerunner), "a step rerunner has rerun()")
    found = rerunner.rerun("r1", "ideas", ["0", "1"], {"seed": 2})
    _must(isinstance(found, Sequence) and all(isinstance(x, str) for x in found), "a rerun gives run ids")
