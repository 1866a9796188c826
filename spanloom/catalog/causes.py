"""Recorded inputs of runs, and the differences that they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog.base import CALLS, EVENT_K, query, r6
from spanloom.operators import causes, detectors
from spanloom.operators.sampling import strata, stratified
from spanloom.plans import testbed as t

FEATURES = f"""{CALLS}, {EVENT_K}, sc AS (SELECT * FROM calls WHERE workflow = 'flow-1' AND scorer IS NULL), f AS (
 SELECT run_id, 'model' AS kind, model AS target, '' AS version FROM sc UNION SELECT run_id, 'param', 'temperature=' || (k % 2) || '.0', '' FROM sc UNION SELECT run_id, 'prompt_version', prompt_version, '' FROM sc
 UNION SELECT run_id, 'prompt_section', 'role', '1' FROM sc UNION SELECT run_id, 'prompt_section', 'ex' || (k % 2), CAST(k % 3 AS VARCHAR) FROM sc
 UNION SELECT CAST(user_id AS VARCHAR), 'code_version', CAST(k % 4 AS VARCHAR), '' FROM ek WHERE user_id % 3 = 1 AND CAST(user_id AS VARCHAR) IN (SELECT run_id FROM sc)
 UNION SELECT CAST(user_id AS VARCHAR), 'param', 'seed=1', '' FROM ek WHERE user_id % 3 = 1 AND k % 8 = 2 AND CAST(user_id AS VARCHAR) IN (SELECT run_id FROM sc)
 UNION SELECT CAST(user_id AS VARCHAR), 'param', 'size=' || (k % 3), '' FROM ek WHERE user_id % 3 = 1 AND k % 8 = 4 AND CAST(user_id AS VARCHAR) IN (SELECT run_id FROM sc))"""
PLACE = {"workflow": "flow-1"}


def _features(spark, sf_dir):
    tables = t.tables(spark, sf_dir)
    return causes.features_by_run(tables["calls"], tables["steps"], PLACE)


@query(f"WITH {FEATURES} SELECT run_id, kind, target, version FROM f")
def features_by_run(spark, sf_dir):
    return _features(spark, sf_dir)


def interval(p: str, n: str, sign: str) -> str:
    return f"({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})"


EFFECTS = f"""hit AS (SELECT DISTINCT run_id FROM sc WHERE k % 10 = 3), runs AS (SELECT DISTINCT f.run_id, hit.run_id IS NOT NULL AS bad FROM f LEFT JOIN hit ON hit.run_id = f.run_id), tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS h FROM runs),
g AS (SELECT kind, target, version, CAST(count(*) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS h1 FROM f JOIN runs USING (run_id) GROUP BY ALL), c AS (SELECT g.*, n - n1 AS n0, h - h1 AS h0 FROM g, tot WHERE n1 >= 5 AND n - n1 >= 5),
w AS (SELECT *, h1 / n1 AS a, h0 / n0 AS b, greatest(0, {interval('h1 / n1', 'n1', '-')}) AS la, least(1, {interval('h1 / n1', 'n1', '+')}) AS ha, greatest(0, {interval('h0 / n0', 'n0', '-')}) AS lb, least(1, {interval('h0 / n0', 'n0', '+')}) AS hb FROM c)"""


@query(f"""WITH {FEATURES}, {EFFECTS} SELECT kind, target, version, round(a - b, 6) AS effect, round(a - b - sqrt((a - la) * (a - la) + (hb - b) * (hb - b)), 6) AS low, round(a - b + sqrt((ha - a) * (ha - a) + (b - lb) * (b - lb)), 6) AS high,
 CAST(n1 AS BIGINT) AS runs_with, CAST(h1 AS BIGINT) AS affected_with, CAST(n0 AS BIGINT) AS runs_without FROM w""")
def effect_ranking(spark, sf_dir):
    tables = t.tables(spark, sf_dir)
    affected = causes.scoped_calls(tables["calls"], PLACE).filter((F.col("vram_after_mb") % 10) == 3).select("run_id")
    out = causes.rank_causes(_features(spark, sf_dir), affected)
    return out.select(*causes.FEATURE, *[r6(F.col(c), c) for c in ("effect", "low", "high")], "runs_with", "affected_with", "runs_without")


STRATA = """o AS (SELECT CAST(doc_id AS VARCHAR) AS span_id, lang AS run_id, doc_id, source FROM documents), st AS (SELECT span_id, 'cluster:' || CASE WHEN doc_id % 3 = 0 THEN 'C' || (doc_id % 4) ELSE 'none' END AS stratum FROM o UNION ALL SELECT span_id, 'finding:F-1' FROM o WHERE doc_id % 50 = 0
 UNION ALL SELECT span_id, 'score:' || CASE lang WHEN 'de' THEN 'low' WHEN 'en' THEN 'mid' ELSE 'high' END FROM (SELECT span_id, run_id AS lang FROM o) WHERE lang IN ('de', 'en', 'fr')),
k AS (SELECT span_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || span_id), span_id) AS k FROM st), f AS (SELECT span_id, min((k, stratum)) AS o FROM k WHERE k <= 60 GROUP BY span_id)"""


def _strata(spark, sf_dir):
    outputs = t.outputs(spark, sf_dir)
    n = F.col("span_id").cast("long")
    clusters = outputs.select("span_id", F.when(n % 3 == 0, F.concat(F.lit("C"), (n % 4).cast("string"))).alias("cluster_id"))
    seen = outputs.filter(n % 50 == 0).select("span_id", F.lit("F-1").alias("finding_id"))
    scores = spark.createDataFrame(
        [("de", "score", 0.1), ("de", "score", 0.9), ("en", "score", 0.5), ("fr", "score", 0.7), ("es", "score", None)],
        "run_id string, kind string, value double"
    )
    return outputs, strata(outputs, clusters, seen, scores)


@query(f"WITH {STRATA} SELECT span_id, stratum FROM st")
def review_strata(spark, sf_dir):
    return _strata(spark, sf_dir)[1]


@query(f"WITH {STRATA}, p AS (SELECT span_id, o[1] AS turn, o[2] AS stratum FROM f ORDER BY o[1], o[2], span_id LIMIT 60) SELECT span_id, turn, stratum FROM p")
def stratified_sample(spark, sf_dir):
    outputs, members = _strata(spark, sf_dir)
    return stratified(outputs, members, 60).select("span_id", F.col("turn").cast("long").alias("turn"), "stratum")


@query(
    f"WITH {CALLS} SELECT run_id, count(*) AS calls, count(DISTINCT step) AS steps FROM calls WHERE workflow = 'flow-2' AND step = '3' AND scorer IS NULL GROUP BY run_id"
)
def scoped_calls(spark, sf_dir):
    mine = causes.scoped_calls(t.calls(spark, sf_dir), {"workflow": "flow-2", "step": "3"})
    return mine.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("step").alias("steps"))


@query(f"WITH {CALLS} SELECT DISTINCT regexp_extract(lower(string_split(model, '/')[-1]), '^([^-:]*)', 1) AS family FROM calls")
def model_families(spark, sf_dir):
    return t.calls(spark, sf_dir).select(detectors.family(F.col("model")).alias("family")).distinct()
