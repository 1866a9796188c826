"""Runs of a flow runner, through the read side of its history: spans and step records."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spanloom.models.ports import field
from spanloom.schemas import FLOW_STEPS


class FlowSource:
    """``history``: ``runs(updated_since=)`` gives run headers (run_id, workflow, updated_at, seed, fork_of), and
    ``open_run(run_id)`` a run with ``spans()`` and ``steps()``. Runs are read one at a time on the driver."""

    def __init__(self, spark: SparkSession, history: Any, workflow: str):
        self.spark, self.history, self.workflow, self.name = spark, history, workflow, f"flow:{workflow}"

    def _runs(self, since: Any = None) -> Iterator[tuple[Any, Any]]:
        for header in self.history.runs(updated_since=since):
            if field(header, "workflow") == self.workflow:
                yield header, self.history.open_run(field(header, "run_id"))

    def spans(self, *, since: dt.datetime | None = None) -> Iterable[dict]:
        for _, run in self._runs(since):
            yield from run.spans()

    def read_new(self, cursor: str | None) -> tuple[list[dict], str | None]:
        """Spans of the runs updated since, and the latest update."""
        out, last = [], cursor
        for header, run in self._runs(cursor):
            out += run.spans()
            updated = str(field(header, "updated_at"))
            last = updated if last is None or updated > last else last
        return out, last

    def step_records(self, *, since: dt.datetime | None = None) -> DataFrame:
        rows = [record(header, step, self.workflow) for header, run in self._runs(since) for step in run.steps()]
        return self.spark.createDataFrame(rows, FLOW_STEPS)


def record(header: Any, step: Any, workflow: str) -> tuple:
    """A row of flow_steps from a run's header and one of its steps."""
    attempts = list(field(step, "attempts") or [])
    reviews = list(field(step, "reviews") or [])
    decisions = [(str(field(r, "decision")) if field(r, "decision") is not None else None, field(r, "actor_kind")) for r in reviews]
    started = field(step, "started_at")
    started = dt.datetime.fromisoformat(started) if isinstance(started, str) else started
    error = field(step, "error")
    return (
        field(header, "run_id"), workflow, field(step, "step"), field(step, "item"), field(step, "kind"), field(step, "status"),
        field(step, "attempt"), len(attempts), [str(field(a, "status")) for a in attempts], field(step, "reused_from"),
        field(header, "fork_of"), field(header, "seed"), decisions, int(any(field(r, "note") for r in reviews)),
        error if error is None or isinstance(error, str) else json.dumps(error, default=str), started,
        None if field(step, "duration_ms") is None else float(field(step, "duration_ms")),
    )


class FlowRerunner:
    """Reruns steps of a run through the flow runner's own ``rerun``."""

    def __init__(self, runner: Any):
        self.runner = runner

    def rerun(self, run_id: str, step: str, items: Iterable[str], params: dict) -> list[str]:
        return list(self.runner.rerun(run_id, step, list(items), dict(params)))
