"""Span stores in SQLite files, read by a Python data source: a partition for each file, ``since`` applied in the file."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.schemas import SPAN


class SpanStore(DataSource):
    """``spark.read.format("spanstore").load(path)``: JSON text of each span, and its blobs by sha."""

    @classmethod
    def name(cls) -> str:
        return "spanstore"

    def schema(self) -> str:
        return "span_id string, start_time string, span string"

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options["path"], self.options.get("since"))


class StoreReader(DataSourceReader):
    def __init__(self, path: str, since: str | None):
        self.path, self.since = path, since

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path.removeprefix("file:"))
        found = [top] if top.is_file() else sorted(top.rglob("spans.db"))
        if not found:
            raise ValueError(f"no spans.db at {top}: the driver and all executors must see the folder")
        return [InputPartition(str(p)) for p in found]

    def read(self, partition) -> Iterator[tuple]:
        import json
        import sqlite3
        from pathlib import Path

        if not Path(partition.value).is_file():
            raise ValueError(f"{partition.value} is not there on this executor: span stores must lie in a folder that all share")
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            version = db.execute("SELECT value FROM meta WHERE key LIKE '%schema_version'").fetchone()
            if not version or str(version[0]) != "1":
                raise ValueError(f"{partition.value}: schema version {version and version[0]!r} is not 1")
            db.row_factory = sqlite3.Row
            where, args = ("WHERE start_time >= ?", (self.since,)) if self.since else ("", ())
            for row in db.execute(f"SELECT * FROM spans {where}", args):
                span = dict(row)
                if '"$blob"' in (span["attributes"] or ""):
                    span["attributes"] = json.dumps({k: self.resolved(db, v) for k, v in json.loads(span["attributes"]).items()})
                yield row["span_id"], row["start_time"], json.dumps(span)

    @staticmethod
    def resolved(db, value):
        """The blob that ``value`` names, looked up by its key so that no table of blobs is held; else ``value`` itself."""
        import json

        sha = value.get("$blob") if isinstance(value, dict) else None
        found = db.execute("SELECT mime, data FROM blobs WHERE sha256 = ?", (str(sha),)).fetchone() if sha is not None else None
        if found is None:
            return value
        text = found["data"] if isinstance(found["data"], str) else bytes(found["data"]).decode("utf-8", "replace")
        return json.loads(text) if found["mime"] == "application/json" else text


def span_store(spark: SparkSession, path: str, *, since: str | dt.datetime | None = None) -> DataFrame:
    """Raw spans of one ``spans.db``, or of every one below a folder that all executors can see."""
    spark.dataSource.register(SpanStore)
    if isinstance(since, dt.datetime):
        since = since.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{since.microsecond // 1000:03}Z"
    reader = spark.read.format("spanstore")
    raw = (reader.option("since", since) if since else reader).load(path)
    text = raw.select(
        F.from_json(
            "span",
            "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time timestamp, end_time timestamp, status_code string, status_message string, attributes string, events string, resource string, links string"
        ).alias("s")
    ).select("s.*")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SPAN).schema}
    parsed = {c: F.from_json(c, kinds[c]) for c in ("attributes", "events", "resource", "links")}
    return text.withColumns(parsed).withColumn("status", F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message"))).select(*kinds)
