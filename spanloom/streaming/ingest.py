"""Incremental ingest with Structured Streaming: the checkpoint is the cursor, each micro-batch an ordinary ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.schemas import SPAN
from spanloom.workspace import Workspace


def ingest_stream(workspace: Workspace, folder: str, checkpoint: str) -> StreamingQuery:
    """Read the span lines that are new in ``folder`` since the checkpoint, then stop.

    Late spans of a known trace have its derived rows made anew; a span id that is stored is never stored again, which no
    watermark could promise. A stream can't go back to a file, so lines that are no span (no JSON, or without an id, a
    name or a start) are written to ``rejected`` in the workspace instead of stopping it.
    """
    lines = workspace.spark.readStream.text(folder)
    spans = lines.select("value", F.from_json("value", SPAN).alias("s"))
    missing = [F.col(f"s.{c}").isNull() for c in ("trace_id", "span_id", "name", "start_time")]
    bad = missing[0] | missing[1] | missing[2] | missing[3]

    def take(df: DataFrame, number: int) -> None:
        rejected = df.filter(bad & (F.trim("value") != "")).select("value")
        if not rejected.isEmpty():
            rejected.write.mode("overwrite").text(f"{workspace.path}/rejected/{number}")
        workspace.ingest(df.filter(~bad).select("s.*"))

    return spans.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates_by_window(calls: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Error rates of a stream of calls by window and step; rows later than ``late`` are dropped."""
    timed = calls.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", late)
    return timed.groupBy(F.window("start_time", window), "step").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("hits"))
