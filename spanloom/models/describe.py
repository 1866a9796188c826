"""Descriptions of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.models.asking import Question, ask_each
from spanloom.models.budget import Budget
from spanloom.models.ports import TextClient
from spanloom.operators.rates import evidence

TEXTS, CHARS = 20, 600
TEXT = {"type": "string"}
DESCRIBE = Question(
    "cluster_description",
    "These texts were put together because they resemble each other. Name the kind of text (description) and the feature that all of them have (in_common), each in a sentence.",
    {"description": TEXT, "in_common": TEXT}
)


def cluster_samples(rows: DataFrame) -> DataFrame:
    """cluster_id, size, data (JSON of up to 20 texts, shortened) of each cluster of ``rows`` (cluster_id, span_id, start_time, text)."""
    mine = rows.filter("cluster_id IS NOT NULL")
    sizes = mine.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    some = evidence(mine, ["cluster_id"], TEXTS).groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("start_time", "span_id", F.substring("text", 1, CHARS).alias("text")))).alias("s")
    )
    return some.join(sizes, "cluster_id").select("cluster_id", "size", F.to_json(F.struct(F.transform("s", lambda x: x["text"]).alias("items"))).alias("data"))


def describe_clusters(rows: DataFrame, known: DataFrame, client: TextClient, budget: Budget, notes: list[str], trace=None) -> list[tuple[str, str, str]]:
    """(cluster_id, description, in_common) of the clusters that ``known`` (cluster_id) lacks, the largest first.

    Clusters are some fifty a step, so their samples come to the driver one by one, not as a whole.
    """
    todo = cluster_samples(rows).join(known.select("cluster_id"), "cluster_id", "left_anti").orderBy(F.col("size").desc(), "cluster_id")
    asked = ask_each(todo.toLocalIterator(), lambda r: r.data, DESCRIBE, client, budget, notes, trace)
    return [(r.cluster_id, str(v["description"]), str(v["in_common"])) for r, v in asked]
