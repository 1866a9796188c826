"""Output analysis: sameness of texts, vectors, clusters by version, outliers, closeness to sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog.base import query, r6, us
from spanloom.catalog.derived import C
from spanloom.operators import outputs as o
from spanloom.operators import vectors
from spanloom.plans import testbed as t
from spanloom.plans.derive import derive
from spanloom.plans.normalize import normalize


@query(
    "SELECT lang AS workflow, source AS step, count(*) AS outputs, round(count(DISTINCT sha256(text)) / count(*), 6) AS distinct_rate FROM documents GROUP BY ALL"
)
def distinct_rate(spark, sf_dir):
    return o.distinct_rate(t.outputs(spark, sf_dir), o.KEYS).select(*o.KEYS, "outputs", r6(F.col("distinct_rate"), "distinct_rate"))


@query(
    """WITH d AS (SELECT lang AS workflow, source AS step, sha256(text) AS sha, CAST(min(doc_id) AS VARCHAR) AS first FROM documents GROUP BY ALL HAVING count(*) > 1) SELECT workflow, step, first AS span_id FROM d"""
)
def duplicate_outputs(spark, sf_dir):
    return o.repeated_first(t.outputs(spark, sf_dir)).select(*o.KEYS, "span_id")


@query(r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), g AS (SELECT DISTINCT lang, doc_id, array_to_string(t[i:i+3], ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - 2)) AS i FROM w)),
c AS (SELECT lang, g, count(*) AS n FROM g GROUP BY ALL) SELECT lang, round(CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS repeated FROM c GROUP BY lang""")
def repeated_ngram_rate(spark, sf_dir):
    rows = t.table(spark, sf_dir, "documents").select("lang", "text")
    return o.repeated_ngrams(rows, ["lang"]).select("lang", r6(F.col("repeated_ngram_rate"), "repeated"))


@query("""WITH n AS (SELECT label, CAST(count(*) AS DOUBLE) AS m FROM embeddings GROUP BY label), v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY ALL)
SELECT label, round((sum(s * s) - sum(q)) / (any_value(m) * (any_value(m) - 1)), 6) AS mean_pairwise FROM s JOIN n USING (label) GROUP BY label HAVING any_value(m) > 1""")
def mean_pairwise(spark, sf_dir):
    return vectors.mean_pairwise(t.table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", r6(F.col("mean_pairwise"), "mean_pairwise"))


@query(
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id, c.vec_id AS other, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS x FROM q JOIN embeddings c ON q.vec_id <> c.vec_id) SELECT vec_id, round(max(x), 5) AS nearest FROM s GROUP BY vec_id"""
)
def nearest_neighbour(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    return vectors.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").select("vec_id", F.round("nearest", 5).alias("nearest"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT vec_id, round(e[1] / n, 6) AS x1, round(e[64] / n, 6) AS x64 FROM n"""
)
def unit_vectors(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("x1"), F.round(F.col("u")[63], 6).alias("x64"))


def _clustered(spark, sf_dir):
    """Documents as outputs in known clusters, by the remainders of their ids."""
    n = F.col("span_id").cast("long")
    rows = t.outputs(spark, sf_dir).withColumns(
        {
            "cluster": F.when(n % 3 == 1, F.when(n % 10 < 8, 0).otherwise(1)).when(n % 7 == 0, 0).otherwise(-1),
            "nearest": F.when(n % 97 == 5, 0.01).otherwise(0.5 + (n % 10) / 100)
        }
    )
    return rows.withColumn("cluster_id", F.when(F.col("cluster") >= 0, F.concat(F.lit("C-"), F.col("cluster").cast("string"))))


ROWS = """o AS (SELECT doc_id, lang AS workflow, source AS step, doc_id % 3 AS ver, sha256(text) AS sha, CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 10 < 8 THEN 0 ELSE 1 END WHEN doc_id % 7 = 0 THEN 0 ELSE -1 END AS cluster,
 CASE WHEN doc_id % 97 = 5 THEN 0.01 ELSE 0.5 + (doc_id % 10) / 100 END AS nearest FROM documents)"""
VERSIONS = """bv AS (SELECT workflow, step, ver, count(*) AS n, count(*) FILTER (WHERE cluster = 0) AS top, min(doc_id) AS seen FROM o GROUP BY ALL),
fl AS (SELECT workflow, step, count(*) AS vs, min(top / n) AS least, arg_min(n, seen) AS n_a, arg_min(top, seen) AS t_a, arg_max(n, seen) AS n_b, arg_max(top, seen) AS t_b FROM bv GROUP BY ALL),
ro AS (SELECT *, CASE WHEN vs > 1 THEN least END AS baseline, vs > 1 AND t_b / n_b - t_a / n_a >= 0.1 AND abs(CASE WHEN (t_a + t_b) / (n_a + n_b) * (1 - (t_a + t_b) / (n_a + n_b)) > 0 THEN (t_b / n_b - t_a / n_a) / sqrt((t_a + t_b) / (n_a + n_b) * (1 - (t_a + t_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)) ELSE 0 END) > 2.5758293035489 AS rose FROM fl)"""


@query(f"WITH {ROWS}, {VERSIONS} SELECT workflow, step, round(baseline, 6) AS baseline, rose FROM ro")
def cluster_share_by_version(spark, sf_dir):
    return o.shares_by_version(_clustered(spark, sf_dir)).select(*o.KEYS, r6(F.col("baseline"), "baseline"), "rose")


@query(f"""WITH {ROWS}, {VERSIONS}, m AS (SELECT workflow, step, count(*) AS total, count(*) FILTER (WHERE cluster = 0) AS hits, count(*) FILTER (WHERE cluster = 0) / count(*) AS share, count(DISTINCT sha) / count(*) AS uniq, min(doc_id) FILTER (WHERE cluster = 0) AS a, max(doc_id) FILTER (WHERE cluster = 0) AS b FROM o GROUP BY ALL)
SELECT m.workflow, m.step, 'largest_cluster_share' AS metric, hits, total, round(share, 6) AS value, CASE WHEN share >= 0.3 THEN 'high' WHEN share >= 0.2 THEN 'medium' ELSE 'low' END AS severity, round(baseline, 6) AS baseline, a * 1000000 AS first_us, b * 1000000 AS last_us
FROM m JOIN ro ON ro.workflow = m.workflow AND ro.step = m.step WHERE hits > 0 AND (share >= 0.2 OR rose)""")
def largest_cluster_share(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    shares = rows.groupBy(*o.KEYS).agg(
        (F.count_if(F.col("cluster") == 0) / F.count(F.lit(1))).alias("largest_cluster_share"),
        (F.max("cluster") + 1).alias("clusters")
    )
    measured = o.distinct_rate(rows, o.KEYS).join(shares, o.KEYS).withColumns({"mean_pairwise_cosine": F.lit(0.0), "repeated_ngram_rate": F.lit(0.0)})
    found = o.homogeneity(rows, measured).rows.filter("metric = 'largest_cluster_share'")
    return found.select(
        *o.KEYS, "metric", "hits", "total", r6(F.col("value"), "value"), "severity", r6(F.col("baseline"), "baseline"),
        us("first_seen", "first_us"), us("last_seen", "last_us")
    )


@query(f"""WITH {ROWS}, d AS (SELECT lang AS workflow, 'all' AS step, doc_id % 5 AS five FROM documents), c AS (SELECT workflow, count(*) AS total, count(DISTINCT five) / count(*) AS uniq, count(DISTINCT five) AS hits FROM d GROUP BY workflow)
SELECT workflow, 'distinct_rate' AS metric, hits, total, round(uniq, 6) AS value, 'high' AS severity FROM c WHERE uniq < 0.5""")
def low_distinct(spark, sf_dir):
    """Outputs that are one of five texts."""
    rows = _clustered(spark, sf_dir).withColumns({"step": F.lit("all"), "text_sha": (F.col("span_id").cast("long") % 5).cast("string"), "cluster": F.lit(-1)})
    measured = o.distinct_rate(rows, o.KEYS).withColumns(
        {"largest_cluster_share": F.lit(0.0), "clusters": F.lit(0), "mean_pairwise_cosine": F.lit(0.0), "repeated_ngram_rate": F.lit(0.0)}
    )
    found = o.homogeneity(rows, measured).rows.filter("metric = 'distinct_rate'")
    return found.select("workflow", "metric", "hits", "total", r6(F.col("value"), "value"), "severity")


@query(f"""WITH {ROWS}, q AS (SELECT workflow, count(*) AS total, quantile_cont(CAST(nearest AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(nearest AS DOUBLE), 0.5) AS q50 FROM o GROUP BY workflow), f AS (SELECT o.workflow, any_value(total) AS total, count(*) AS hits FROM o JOIN q ON q.workflow = o.workflow WHERE nearest < q50 - 6 * greatest(q50 - q25, 0.02) GROUP BY o.workflow)
SELECT workflow, 'outlier_rate' AS metric, hits, total, round(hits / total, 6) AS value FROM f WHERE hits >= 3 AND total >= 20""")
def outlier_rate(spark, sf_dir):
    rows = _clustered(spark, sf_dir).withColumn("step", F.lit(None).cast("string"))
    return o.outliers(rows).rows.select("workflow", "metric", "hits", "total", r6(F.col("value"), "value"))


@query(
    f"""WITH {ROWS}, t AS (SELECT workflow, step, count(*) AS total FROM o GROUP BY ALL) SELECT 'C-' || cluster AS id, o.workflow, o.step, cluster AS rank, count(*) AS size, any_value(total) AS total FROM o JOIN t ON t.workflow = o.workflow AND t.step = o.step WHERE cluster >= 0 GROUP BY ALL"""
)
def cluster_sizes(spark, sf_dir):
    rows = _clustered(spark, sf_dir).withColumn("center", F.lit("x"))
    return o.cluster_table(rows).drop("center")


@query("""WITH e AS (SELECT label, vec_id, vec_id % 2 AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT label, 's' || vec_id AS section, e AS se FROM e WHERE vec_id < 40), p AS (SELECT e.label, section, avg(list_dot_product(e.e, se)) FILTER (WHERE c = 0) AS a, avg(list_dot_product(e.e, se)) FILTER (WHERE c = 1) AS b FROM e JOIN s ON s.label = e.label GROUP BY ALL)
SELECT label, section, round(a, 6) AS cluster, round(b, 6) AS others, round(a - b, 6) AS difference FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def section_closeness(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 2).alias("cluster"))
    sections = e.filter("vec_id < 40").select(
        "label", F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("section"), F.lit("1").alias("version"),
        F.col("embedding").alias("section_embedding")
    )
    out = vectors.closeness(e, sections, ["label"])
    return out.select("label", "section", *[r6(F.col(c), c) for c in ("cluster", "others", "difference")])


@query(f"""WITH {C}, o AS (SELECT workflow, step, turn % 2 AS ver, at_us, n, substr(text, 3, 7) AS cut FROM c WHERE role = 'user' AND turn % 3 > 0 AND turn % 5 <> 4), f AS (SELECT workflow, step, CAST(ver AS VARCHAR) AS version, arg_min(cut, (at_us, n)) AS text FROM o GROUP BY ALL)
SELECT workflow, step, 'head' AS section, version, text FROM f WHERE trim(text) <> ''""")
def section_texts(spark, sf_dir):
    """Each prompt section as the first call that has it shows it."""
    spans = normalize(t.raw_spans(spark, sf_dir))
    tables = derive(spans)
    return o.section_texts(spans, tables["outputs"], tables["calls"]).drop("text_sha")


@query(
    "SELECT lang AS workflow, count(*) AS outputs FROM documents d WHERE (SELECT count(*) FROM documents x WHERE x.lang = d.lang AND x.source = d.source) >= 20 GROUP BY lang"
)
def large_groups(spark, sf_dir):
    return o.large_groups(t.outputs(spark, sf_dir)).groupBy("workflow").agg(F.count(F.lit(1)).alias("outputs"))


@query(None)
def leader_clusters(spark, sf_dir):
    """Iterative, so without SQL; tests hold it against a plain version."""
    e = t.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("step"), F.col("vec_id").cast("string").alias("span_id"), "embedding")
    return vectors.leader_clusters(e, ["step"], "span_id", "embedding", similarity=0.25)
