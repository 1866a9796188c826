"""Causes: recorded inputs of the runs of a finding, ranked by the difference they make."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.stats import difference_ci

LEAST_RUNS, TOP = 5, 5
#: Kinds, the most specific first: of equal effects that of the more specific one leads.
KINDS = ("prompt_section", "param", "model", "prompt_version", "code_version")
FEATURE = ["kind", "target", "version"]


def scoped_calls(calls: DataFrame, scope: Mapping[str, str]) -> DataFrame:
    """The recorded calls of a finding's place: its step, and its scorer or else the generator."""
    mine = calls.filter("replay_of IS NULL").filter(F.col("workflow").eqNullSafe(scope.get("workflow")) & F.col("scorer").eqNullSafe(scope.get("scorer")))
    return mine.filter(F.col("step") == scope["step"]) if scope.get("step") else mine


def features_by_run(calls: DataFrame, steps: DataFrame, scope: Mapping[str, str] | None = None) -> DataFrame:
    """run_id, kind, target, version: the recorded inputs of the runs that have calls in the scope (all, without one).

    A missing model, temperature or code version is the text None; a missing prompt version is no feature.
    """
    if scope is not None:
        calls = scoped_calls(calls, scope)
        steps = steps.filter(F.col("workflow").eqNullSafe(scope.get("workflow")))
        steps = steps.filter(F.col("step") == scope["step"]) if scope.get("step") else steps
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    row = lambda kind, target, version=None: F.struct(
        F.lit(kind).alias("kind"), target.alias("target"), (F.lit("") if version is None else version).alias("version")
    )
    own = [
        row("model", text("model")), row("param", F.concat(F.lit("temperature="), text("temperature"))),
        F.when(F.col("template_version").isNotNull(), row("prompt_version", F.col("template_version").cast("string")))
    ]
    listed = F.transform(
        F.coalesce("sections", F.array().cast("array<struct<id:string,version:string,start:int,end:int>>")),
        lambda s: row("prompt_section", F.coalesce(s["id"], F.lit("None")), F.coalesce(s["version"], F.lit("None")))
    )
    of_calls = calls.select("run_id", F.explode(F.array_compact(F.concat(F.array(*own), listed))).alias("f")).select("run_id", "f.*")
    code = steps.join(calls.select("run_id").distinct(), "run_id", "left_semi")
    params = F.transform(
        F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))),
        lambda e: row("param", F.concat(e["key"], F.lit("="), e["value"]))
    )
    of_steps = code.select("run_id", F.explode(F.concat(F.array(row("code_version", text("step_version"))), params)).alias("f")).select("run_id", "f.*")
    return of_calls.unionByName(of_steps).distinct()


def rank_causes(features: DataFrame, affected: DataFrame, keys: list[str] = FEATURE) -> DataFrame:
    """keys, effect (difference of the affected shares), low, high (Newcombe), runs_with, affected_with, runs_without: the
    features that at least five runs have and five lack, best first. Runs are those that have features."""
    runs = features.select("run_id").distinct().join(affected.select("run_id", F.lit(1).alias("_hit")).distinct(), "run_id", "left")
    totals = runs.agg(F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_m"))
    by = features.select("run_id", *keys).distinct().join(runs, "run_id").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs_with"), F.count("_hit").alias("affected_with")
    )
    by = by.join(F.broadcast(totals)).withColumns({"runs_without": F.col("_n") - F.col("runs_with"), "_without": F.col("_m") - F.col("affected_with")})
    by = by.filter((F.col("runs_with") >= LEAST_RUNS) & (F.col("runs_without") >= LEAST_RUNS))
    low, high = difference_ci(F.col("affected_with"), F.col("runs_with"), F.col("_without"), F.col("runs_without"))
    effect = F.col("affected_with") / F.col("runs_with") - F.col("_without") / F.col("runs_without")
    out = by.select(*keys, effect.alias("effect"), low.alias("low"), high.alias("high"), "runs_with", "affected_with", "runs_without")
    order = [F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))] if "kind" in keys else []
    return out.orderBy(F.bround(F.col("effect"), 2).desc(), *order, *[k for k in keys if k != "kind"])
