"""Stand-ins for every port, the same answers each time; each notes its calls in ``calls``."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

import numpy as np

from spanloom.models.replay import output_text
from spanloom.testing.analyst import answer

#: Words that the semantic embedder leaves out.
STOPWORDS = frozenset("a an the of and or to in on at as is are was be by for with from into it its this that".split())


class FakeEmbedder:
    """Vectors from hashes. Plain: unrelated vectors for different texts. ``by_words``: each word that is no stopword adds
    1 or -1 to one dimension, so that texts with many words in common are near each other. Picklable."""

    def __init__(self, dimensions: int = 64, *, by_words: bool = False):
        self.dimensions, self.by_words, self.calls = dimensions, by_words, []
        self.model_id = "fake-semantic" if by_words else "fake-hash"

    @classmethod
    def semantic(cls, dimensions: int = 256) -> FakeEmbedder:
        return cls(dimensions, by_words=True)

    def _vector(self, text: str) -> np.ndarray:
        v = np.zeros(self.dimensions)
        if self.by_words:
            digests = [hashlib.sha256(w.encode()).digest() for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOPWORDS]
            np.add.at(v, [int.from_bytes(d[:4], "big") % self.dimensions for d in digests], [1.0 if d[4] & 1 else -1.0 for d in digests])
        else:
            v = np.random.default_rng(list(hashlib.sha256(text.encode()).digest())).normal(size=self.dimensions)
        norm = np.linalg.norm(v)
        return v / norm if norm else np.eye(1, self.dimensions)[0]

    def embed(self, texts: Sequence[str], *, trace: Mapping | None = None) -> list[list[float]]:
        self.calls.append(list(texts))
        return [self._vector(t).tolist() for t in texts]


class FakeTextClient:
    """Answers by the schema's title: a value, a function of the data, or an exception to raise; else the scripted analyst."""

    def __init__(self, **answers: Any):
        self.answers, self.calls = answers, []

    def complete(self, messages: Sequence[Mapping], *, schema: Mapping | None = None, trace: Mapping | None = None, **params: Any) -> dict:
        self.calls.append({"messages": list(messages), "schema": schema, "trace": trace, **params})
        data, title = messages[-1]["content"], (schema or {}).get("title", "")
        said = self.answers[title] if title in self.answers else answer(title, data)
        said = said(data) if callable(said) else said
        if isinstance(said, Exception):
            raise said
        text = str(said)
        return {
            "text": text, "parsed": said if schema else None, "error": None,
            "usage": {"input_tokens": sum(len(m["content"]) for m in messages) // 4, "output_tokens": len(text) // 4}
        }


class FakeReplayer:
    """Replays by a function of (span, sections to their new text or None); its text is the new output."""

    def __init__(self, write: Callable[[Mapping, Mapping], str] | None = None, **attributes: Any):
        self.write, self.attributes, self.calls = write or (lambda span, sections: output_text(span)), attributes, []

    def replay_call(self, call_span: Mapping, overrides: Mapping, *, trace: Mapping | None = None) -> dict:
        self.calls.append((call_span["span_id"], dict(overrides)))
        text = self.write(call_span, overrides.get("prompt.sections", {}))
        found = {
            "gen_ai.output.messages": [{"role": "assistant", "content": text}], "gen_ai.usage.input_tokens": 10,
            "gen_ai.usage.output_tokens": len(text) // 4
        }
        return {"status": {"code": "ok"}, "attributes": found | self.attributes}


class FakeStepRerunner:
    def __init__(self):
        self.calls = []

    def rerun(self, run_id: str, step: str, items: Sequence[str], params: Mapping) -> list[str]:
        self.calls.append((run_id, step, list(items), dict(params)))
        return [f"{run_id}-rerun-{i}" for i, _ in enumerate(items)]


class FakeSource:
    """Spans in memory."""

    def __init__(self, spans: Iterable[Mapping], name: str = "fake"):
        self.name, self.rows, self.calls = name, [dict(s) for s in spans], []

    def spans(self, *, since: dt.datetime | None = None) -> list[dict]:
        self.calls.append(since)
        start = since.astimezone(dt.UTC).isoformat() if since else ""
        return [s for s in self.rows if not since or str(s["start_time"]).replace("Z", "+00:00") >= start[:10]]


class ScriptedIO:
    """A person whose answers are known: a list in turn, or a function of (question, choices)."""

    def __init__(self, answers: Iterable[str] | Callable[[str, Sequence[str]], str]):
        self.answers, self.shown, self.asked = answers if callable(answers) else iter(answers), [], []

    def show(self, text: str) -> None:
        self.shown.append(text)

    def ask(self, question: str, choices: Sequence[str] = ()) -> str:
        self.asked.append(question)
        return self.answers(question, choices) if callable(self.answers) else next(self.answers, "")


class FakeRun:
    def __init__(self, spans: list[dict], steps: list[dict]):
        self._spans, self._steps = spans, steps

    def spans(self) -> list[dict]:
        return list(self._spans)

    def steps(self) -> list[dict]:
        return list(self._steps)


class FakeHistory:
    """A flow runner's run history in memory: add() runs, fork() them, read them by runs() and open_run()."""

    def __init__(self):
        self.headers: dict[str, dict] = {}
        self.opened: dict[str, FakeRun] = {}

    def add(
        self, run_id: str, steps: list[dict], spans: list[dict] = (), *, workflow: str = "w",
        updated_at: str = "2026-01-01T00:00:00+00:00", seed: int | None = None, fork_of: str | None = None
    ) -> str:
        self.headers[run_id] = {"run_id": run_id, "workflow": workflow, "updated_at": updated_at, "seed": seed, "fork_of": fork_of}
        self.opened[run_id] = FakeRun(list(spans), list(steps))
        return run_id

    def fork(self, run_id: str, new_id: str, redone: Sequence[str], updated_at: str) -> str:
        """A run that reuses the steps of another but for ``redone``."""
        steps = [s if s["step"] in redone else s | {"reused_from": run_id} for s in self.opened[run_id].steps()]
        return self.add(new_id, steps, workflow=self.headers[run_id]["workflow"], updated_at=updated_at, fork_of=run_id)

    def runs(self, *, updated_since: str | None = None) -> list[dict]:
        return [h for h in self.headers.values() if updated_since is None or h["updated_at"] > str(updated_since)]

    def open_run(self, run_id: str) -> FakeRun:
        return self.opened[run_id]
