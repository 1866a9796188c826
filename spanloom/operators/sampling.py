"""Stratified samples in a seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, stratum: str, key: str, n: int, *, seed: int = 0) -> DataFrame:
    """``n`` rows: the strata take turns, each in the order of a seeded hash. No stratum sends more than n rows on."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    turns = df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).orderBy("_k", stratum).limit(n)
    return turns.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_k", stratum)).cast("long")).drop("_k")


def score_bucket(value):
    return F.when(value < 0.34, "low").when(value < 0.67, "mid").otherwise("high")


def strata(outputs: DataFrame, clusters: DataFrame, evidence: DataFrame, selections: DataFrame) -> DataFrame:
    """span_id, stratum: the strata of each output (span_id, run_id): its cluster, or that it has none; the findings it is
    evidence of; the level of its run's lowest score. ``clusters``: span_id, cluster_id; ``evidence``: span_id, finding_id."""
    ids = outputs.select("span_id", "run_id")
    named = ids.join(clusters.select("span_id", "cluster_id"), "span_id", "left").select(
        "span_id", F.concat(F.lit("cluster:"), F.coalesce("cluster_id", F.lit("none"))).alias("stratum")
    )
    of_findings = ids.join(evidence, "span_id").select("span_id", F.concat(F.lit("finding:"), "finding_id").alias("stratum"))
    lowest = selections.filter("kind = 'score' AND value IS NOT NULL").groupBy("run_id").agg(F.min("value").alias("value"))
    of_scores = ids.join(lowest, "run_id").select("span_id", F.concat(F.lit("score:"), score_bucket(F.col("value"))).alias("stratum"))
    return named.union(of_findings).union(of_scores)


def stratified(outputs: DataFrame, members: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """``n`` of the outputs: strata take turns in a seeded order; an output that several strata offer is taken once.

    Every stratum offers its first ``n`` at most, which is enough, since a taken output only moves the others forward.
    """
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "span_id")), "span_id")
    offered = members.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n)
    once = offered.groupBy("span_id").agg(F.min(F.struct("_k", "stratum")).alias("_o"))
    first = once.orderBy("_o", "span_id").limit(n)
    return outputs.join(
        first.select("span_id", F.col("_o.stratum").alias("stratum"), F.col("_o._k").alias("turn")), "span_id"
    ).orderBy("turn", "stratum", "span_id")
