"""What the library asks of the caller's models. Anything with these methods will do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, Protocol, runtime_checkable


@runtime_checkable
class TextClient(Protocol):
    """A result has ``text``, ``parsed``, ``error`` and ``usage``, as keys or attributes."""

    def complete(self, messages: Sequence[Mapping], *, schema: Mapping | None = None, trace: Mapping | None = None, **params: Any) -> Any: ...


@runtime_checkable
class Embedder(Protocol):
    model_id: str
    dimensions: int

    def embed(self, texts: Sequence[str], *, trace: Mapping | None = None) -> list[list[float]]: ...


@runtime_checkable
class Replayer(Protocol):
    def replay_call(self, call_span: Mapping, overrides: Mapping, *, trace: Mapping | None = None) -> Mapping: ...


@runtime_checkable
class StepRerunner(Protocol):
    def rerun(self, run_id: str, step: str, items: Sequence[str], params: Mapping) -> list[str]: ...


def field(result: Any, name: str, default: Any = None) -> Any:
    return result.get(name, default) if isinstance(result, Mapping) else getattr(result, name, default)
