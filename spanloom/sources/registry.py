"""Sources: strings ``kind:target``, DataFrames, rows, and objects of one's own; whole or only what is new."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from pathlib import PurePosixPath
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.errors import SourceError
from spanloom.schemas import FLOW_STEPS, SPAN
from spanloom.sources import files
from spanloom.sources.sqlite import span_store
from spanloom.storage import Storage


class RecordSource(Protocol):
    """A source of one's own: spans are dicts of the span's fields, or a DataFrame. ``step_records(since=)`` and
    ``read_new(cursor)`` (spans and the next cursor) may be there too."""

    name: str

    def spans(self, *, since: dt.datetime | None = None) -> DataFrame | Iterable[dict]: ...


class Export:
    """An export of a tracing tool: the workflow is named, or the file's stem."""

    def __init__(self, spark: SparkSession, path: str, workflow: str | None = None, *, read: Callable[..., DataFrame]):
        self.name, self._spark, self._path, self._read = path, spark, path, read
        self.workflow = workflow or PurePosixPath(path).stem

    def spans(self, *, since: dt.datetime | None = None) -> DataFrame:
        return self._read(self._spark, self._path, workflow=self.workflow)


def phoenix_export(spark: SparkSession, path: str, workflow: str | None = None) -> Export:
    return Export(spark, path, workflow, read=files.phoenix)


def langfuse_export(spark: SparkSession, path: str, workflow: str | None = None) -> Export:
    return Export(spark, path, workflow, read=files.langfuse)


def run_folders(spark: SparkSession, path: str | list[str], *, since: dt.datetime | None = None) -> DataFrame:
    """Everything below a folder: span lines and SQLite span stores."""
    found = [f.path for p in ([path] if isinstance(path, str) else path) for f in Storage(spark).files(p, ("spans.jsonl", "spans.db"))]
    parts = [files.jsonl(spark, lines)] if (lines := [p for p in found if p.endswith(".jsonl")]) else []
    parts += [span_store(spark, p, since=since) for p in found if p.endswith(".db")]
    if not parts:
        raise SourceError(f"neither spans.jsonl nor spans.db below {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stem(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """One file (or pattern) is one workflow, named by its stem."""

    def run(spark: SparkSession, path: str | list[str]) -> DataFrame:
        paths = [path] if isinstance(path, str) else path
        out = read(spark, paths[0], workflow=PurePosixPath(paths[0]).stem)
        for p in paths[1:]:
            out = out.unionByName(read(spark, p, workflow=PurePosixPath(p).stem))
        return out

    return run


#: Kinds whose files are read whole whenever they change.
FILES: dict[str, Callable[..., DataFrame]] = {"otlp": files.otlp, "jsonl": files.jsonl, "phoenix": _stem(files.phoenix), "langfuse": _stem(files.langfuse)}
#: Kinds that apply ``since`` themselves.
STORES: dict[str, Callable[..., DataFrame]] = {"store": span_store, "runs": run_folders}
#: Opens the run history of a flow runner: storage to an object with runs() and open_run(); set by whoever has one.
FLOW_HISTORY: list[Callable[[str], Any]] = []


def split(source: str) -> tuple[str, str]:
    kind, _, target = source.partition(":")
    if kind not in {*FILES, *STORES, "flow"} or not target:
        raise SourceError(f"{source!r} is not kind:target with a kind of {', '.join(sorted([*FILES, *STORES, 'flow']))}")
    return kind, target


def flow_source(spark: SparkSession, target: str):
    from spanloom.sources.flow import FlowSource

    storage, _, workflow = target.rpartition("/")
    if not storage or not workflow:
        raise SourceError(f"flow:{target} is not flow:<storage>/<workflow>")
    if not FLOW_HISTORY:
        raise SourceError("no flow runner: add a function that opens its history to FLOW_HISTORY")
    return FlowSource(spark, FLOW_HISTORY[-1](storage), workflow)


def as_spans(spark: SparkSession, found: DataFrame | Iterable[dict]) -> DataFrame:
    """Span dicts as a DataFrame; other than text in an attribute becomes JSON."""
    if isinstance(found, DataFrame):
        return found
    import json

    rows = [json.dumps(r if isinstance(r, dict) else dict(r), default=str) for r in found]
    return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", SPAN).alias("s")).select("s.*")


def _since(df: DataFrame, since: dt.datetime | None) -> DataFrame:
    return df if since is None else df.filter(F.col("start_time") >= F.lit(since))


def open_source(spark: SparkSession, source, *, since: dt.datetime | None = None) -> DataFrame:
    """Raw spans of a source string, a DataFrame, an iterable of span rows, or an object with ``spans``."""
    if isinstance(source, str):
        kind, target = split(source)
        if kind == "flow":
            source = flow_source(spark, target)
        else:
            found = STORES[kind](spark, target, since=since) if kind in STORES else FILES[kind](spark, target)
            return _since(found, since)
    if hasattr(source, "spans") and not isinstance(source, DataFrame):
        return _since(as_spans(spark, source.spans(since=since)), since)
    if isinstance(source, (DataFrame, Iterable)):
        return _since(as_spans(spark, source), since)
    raise SourceError(f"not a source: {source!r}")


def step_records(spark: SparkSession, source, *, since: dt.datetime | None = None) -> DataFrame | None:
    """Records of a flow runner's steps, for the sources that have them."""
    if isinstance(source, str) and source.startswith("flow:"):
        source = flow_source(spark, split(source)[1])
    if not hasattr(source, "step_records"):
        return None
    found = source.step_records(since=since)
    return found if isinstance(found, DataFrame) else spark.createDataFrame(list(found), FLOW_STEPS)


def read_new(spark: SparkSession, source, cursor: dict | None, *, latest: dt.datetime | None, longest_ms: float) -> tuple[DataFrame | None, dict]:
    """Raw spans that may be new since ``cursor``, and the next cursor. None: nothing changed.

    Files are read again where their size or time of change differs. Other sources are asked for spans since the latest
    start less the longest span ever seen, as parents arrive after their children.
    """
    cursor = cursor or {}
    if isinstance(source, str) and split(source)[0] in FILES:
        kind, target = split(source)
        seen = {f.path: [f.modified, f.size] for f in Storage(spark).files(target)}
        changed = [p for p, state in seen.items() if cursor.get("files", {}).get(p) != state]
        return (FILES[kind](spark, changed) if changed else None), {"files": seen}
    if hasattr(source, "read_new"):
        found, after = source.read_new(cursor.get("own"))
        return as_spans(spark, found), {"own": after}
    since = latest - dt.timedelta(milliseconds=longest_ms) if latest is not None and cursor.get("read") else None
    return open_source(spark, source, since=since), {"read": True}


def name_of(source) -> str | None:
    """A name to keep a cursor under; None for what has none."""
    return source if isinstance(source, str) else getattr(source, "name", None) if hasattr(source, "spans") else None
