"""Version changes, ranks and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog.base import CALLS, SELECTIONS, STEPS, query, r6, shown
from spanloom.functions import stats
from spanloom.operators import detectors as d
from spanloom.plans import testbed as t


def edges(source: str, keys: str, version: str, name: str = "") -> str:
    """Boundaries e and the rows x of both sides of each."""
    on = " AND ".join(f"c.{k.strip()} IS NOT DISTINCT FROM e.{k.strip()}" for k in keys.split(","))
    return f"""v{name} AS (SELECT {keys}, {version} AS ver, min((start_time, span_id)) AS seen FROM {source} WHERE {version} IS NOT NULL GROUP BY ALL), e{name} AS (SELECT {keys}, lag(ver) OVER (PARTITION BY {keys} ORDER BY seen) AS before, ver AS after FROM v{name}),
x{name} AS (SELECT c.*, e.before, e.after, CASE WHEN c.{version} = e.before THEN 'a' ELSE 'b' END AS side FROM {source} c JOIN e{name} e ON {on} AND e.before IS NOT NULL AND c.{version} IN (e.before, e.after))"""


KEYS = "workflow, step, scorer, model"


def latency_sql(keys: str, value: str = "latency_ms", name: str = "", extra: str = "") -> str:
    """z: both sides' counts, U, z and medians of each boundary."""
    g = f"{keys}, before, after"
    return f"""r{name} AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY {value}) + (count(*) OVER (PARTITION BY {g}, {value}) - 1) / 2.0 AS rk FROM x{name} WHERE {value} IS NOT NULL),
g{name} AS (SELECT {g}, count(*) FILTER (WHERE side = 'a') AS n_a, count(*) FILTER (WHERE side = 'b') AS n_b, CAST(sum(rk) FILTER (WHERE side = 'a') AS DOUBLE) AS ra, quantile_cont({value}, 0.5) FILTER (WHERE side = 'a') AS baseline, quantile_cont({value}, 0.5) FILTER (WHERE side = 'b') AS value{extra} FROM r{name} GROUP BY ALL),
z{name} AS (SELECT *, coalesce(ra - n_a * (n_a + 1) / 2.0, 0) AS u, CASE WHEN n_a * n_b > 0 THEN (ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) / sqrt(CAST(n_a AS DOUBLE) * n_b * (n_a + n_b + 1) / 12) ELSE 0 END AS z FROM g{name})"""


@query(f"WITH {CALLS}, {edges('calls', 'workflow, step', 'prompt_version')} SELECT workflow, step, before, after FROM e WHERE before IS NOT NULL")
def version_boundaries(spark, sf_dir):
    return d.boundaries(d.own_calls(t.tables(spark, sf_dir)), ["workflow", "step"], "template_version")


SLOWER = "n_a >= 20 AND n_b >= 20 AND value / baseline >= 1.2 AND abs(z) > 2.5758293035489"


@query(f"""WITH {CALLS}, {edges('calls', 'step', 'prompt_version')}, {latency_sql('step')}
SELECT step, before, after, n_a, n_b, round(u, 6) AS u, round(z, 6) AS z, round(baseline, 6) AS baseline, round(value, 6) AS value, {SLOWER} AS regressed FROM z""")
def latency_regression(spark, sf_dir):
    out = d.latency_changes(d.own_calls(t.tables(spark, sf_dir)), keys=["step"], version="template_version")
    return out.select(
        "step", "before", "after", "n_a", "n_b", r6(F.col("u"), "u"), r6(F.col("z"), "z"), r6(F.col("baseline"), "baseline"),
        r6(F.col("value"), "value"), "regressed"
    )


ERRORS = """g AS (SELECT {g}, CAST(count(*) FILTER (WHERE side = 'a') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE side = 'b') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE side = 'a' AND status IN ('failed', 'error')) AS DOUBLE) AS ha, CAST(count(*) FILTER (WHERE side = 'b' AND status IN ('failed', 'error')) AS DOUBLE) AS hb FROM x GROUP BY ALL),
s AS (SELECT *, sqrt((ha + hb) / (a + b) * (1 - (ha + hb) / (a + b)) * (1 / a + 1 / b)) AS se FROM g), q AS (SELECT *, CASE WHEN se > 0 THEN (hb / b - ha / a) / se ELSE 0 END AS z FROM s)"""


@query(f"""WITH {CALLS}, {edges('calls', 'step', 'prompt_version')}, {ERRORS.format(g='step, before, after')}
SELECT step, before, after, CAST(ha AS BIGINT) AS hits_a, CAST(hb AS BIGINT) AS hits_b, round(z, 6) AS z, a >= 20 AND b >= 20 AND hb / b - ha / a >= 0.02 AND abs(z) > 2.5758293035489 AS regressed FROM q""")
def error_regression_z(spark, sf_dir):
    out = d.error_changes(d.own_calls(t.tables(spark, sf_dir)), keys=["step"], version="template_version")
    return out.select("step", "before", "after", "hits_a", "hits_b", r6(F.col("z"), "z"), "regressed")


@query(f"""WITH {CALLS}, {SELECTIONS}, p AS (SELECT run_id, arg_max(prompt_version, (start_time, span_id)) AS prompt_version FROM calls WHERE scorer IS NULL GROUP BY run_id), sc AS (SELECT s.*, p.prompt_version FROM selections s LEFT JOIN p ON p.run_id = s.run_id WHERE kind = 'score' AND value IS NOT NULL),
{edges('sc', 'workflow, scorer', 'prompt_version')}, {latency_sql('workflow, scorer', 'value', extra=", avg(value) FILTER (WHERE side = 'a') AS mean_a, avg(value) FILTER (WHERE side = 'b') AS mean_b")}
SELECT workflow, scorer, before, after, n_a, n_b, round(z, 6) AS z, round(mean_a, 6) AS baseline, round(mean_b, 6) AS value, n_a >= 20 AND n_b >= 20 AND mean_a - mean_b >= 0.05 AND abs(z) > 2.5758293035489 AS regressed FROM z""")
def score_regression(spark, sf_dir):
    tables = t.tables(spark, sf_dir)
    scored = d.scores(tables).filter("value IS NOT NULL").join(d.prompt_of_run(tables), "run_id", "left")
    out = d.score_changes(scored, keys=["workflow", "scorer"], version="prompt_version")
    return out.select(
        "workflow", "scorer", "before", "after", "n_a", "n_b", r6(F.col("z"), "z"), r6(F.col("baseline"), "baseline"),
        r6(F.col("value"), "value"), "regressed"
    )


@query(f"""WITH {STEPS}, ex AS (SELECT * FROM steps WHERE executed = 1), {edges('ex', 'workflow, step', 'code_version')}, {ERRORS.format(g='workflow, step, before, after')},
bad AS (SELECT * FROM q WHERE a >= 20 AND b >= 20 AND hb / b - ha / a >= 0.02 AND abs(z) > 2.5758293035489), n AS (SELECT workflow, step, count(*) AS total FROM ex GROUP BY ALL)
SELECT bad.workflow, bad.step, after AS code_version, 'error_rate' AS metric, count(*) AS hits, any_value(total) AS total, round(any_value(hb / b), 6) AS value, CASE WHEN any_value(hb / b - ha / a) >= 0.1 THEN 'high' ELSE 'medium' END AS severity, 'regression' AS category,
 min(epoch_us(start_time)) AS first_us, max(epoch_us(start_time)) AS last_us, round(any_value(ha / a), 6) AS baseline, before
FROM bad JOIN n ON n.workflow = bad.workflow AND n.step = bad.step JOIN ex ON ex.workflow = bad.workflow AND ex.step = bad.step AND ex.code_version = bad.after AND ex.status = 'failed' GROUP BY bad.workflow, bad.step, after, before""")
def regressions(spark, sf_dir):
    """The findings that a regression becomes: steps whose new code version fails more often."""
    steps = t.steps(spark, sf_dir).filter("executed = 1").withColumn("code_version", F.col("step_version"))
    keys, failed = ["workflow", "step"], F.col("status").isin(*d.FAILED)
    found = d._regressions(d.error_changes(steps, keys=keys, version="code_version"), steps, keys, "code_version", "error_rate", failed)
    return shown(found.rows, *keys, "code_version", more=(r6(F.col("baseline"), "baseline"), "before"))


WILSON = """((p + 1.96 * 1.96 / (2 * n)) {sign} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"""


@query(
    f"""WITH {CALLS}, g AS (SELECT step, count(*) FILTER (WHERE status = 'error') AS hits, CAST(count(*) AS DOUBLE) AS n FROM calls GROUP BY step), s AS (SELECT *, hits / n AS p FROM g) SELECT step, hits, round(greatest(0, {WILSON.format(sign='-')}), 6) AS low, round(least(1, {WILSON.format(sign='+')}), 6) AS high FROM s"""
)
def wilson_ci(spark, sf_dir):
    by = d.own_calls(t.tables(spark, sf_dir)).groupBy("step").agg(F.count_if(F.col("status") == "error").alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return by.select("step", "hits", r6(low, "low"), r6(high, "high"))


@query(
    f"""WITH {CALLS} SELECT step, round(quantile_cont(latency_ms, 0.25), 6) AS q25, round(quantile_cont(latency_ms, 0.5), 6) AS q50, round(quantile_cont(latency_ms, 0.95), 6) AS q95 FROM calls GROUP BY step"""
)
def latency_percentiles(spark, sf_dir):
    found = stats.quantiles(d.own_calls(t.tables(spark, sf_dir)), ["step"], "latency_ms", {"q25": 0.25, "q50": 0.5, "q95": 0.95})
    return found.select("step", *[r6(F.col(n), n) for n in ("q25", "q50", "q95")])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def median_of_hot_groups(spark, sf_dir):
    """Three groups hold all rows; no task sorts one of them as a whole."""
    return stats.medians(t.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", r6(F.col("median"), "median"), "n")


@query(
    "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS mid_rank FROM lineitem"
)
def mid_ranks(spark, sf_dir):
    out = stats.ranked(t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.col("_rank").cast("double").alias("mid_rank"))
