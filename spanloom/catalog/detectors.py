"""The detectors' own code on the testbed's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom import findings as fs
from spanloom.catalog.base import CALLS, EVENT_K, SELECTIONS, STEPS, query, r6, rate_sql, shown, us
from spanloom.operators import detectors as d
from spanloom.operators.rates import evidence
from spanloom.plans import testbed as t

CALL_KEYS = "workflow, step, model, scorer, prompt_version"


@query(
    f"WITH {CALLS} " + rate_sql(
        "calls", CALL_KEYS,
        [
            ("error_rate", "status = 'error'", 0.01, 0.2, 0.05), ("retry_rate", "retries > 0", 0.01, 0.2, 0.05),
            ("repair_rate", "structured_path IN ('retried', 'repaired', 'failed')", 0.01, 0.2, 0.05)
        ]
    )
)
def error_rate(spark, sf_dir):
    return shown(d.call_failures(t.tables(spark, sf_dir)).rows, *CALL_KEYS.split(", "))


@query(f"WITH {STEPS} " + rate_sql("(SELECT * FROM steps WHERE executed = 1)", "workflow, step", [("step_error_rate", "status = 'failed'", 0.01, 0.2, 0.05)]))
def step_error_rate(spark, sf_dir):
    return shown(d.step_failures({"steps": t.steps(spark, sf_dir)}).rows, "workflow", "step")


NEAR = "count(*) FILTER (WHERE finish_reason = 'length' AND context_limit > 0 AND input_tokens >= 0.9 * context_limit) AS near_context_limit"
CUT = "count(*) FILTER (WHERE finish_reason = 'length' AND structured_path IN ('retried', 'repaired', 'failed')) AS repaired"


@query(
    f"WITH {CALLS} " + rate_sql(
        "calls", "workflow, step, model", [("truncation_rate", "finish_reason = 'length'", 0.01, 0.05, 0.01)],
        more=f"{NEAR} ;; {CUT}"
    )
)
def truncation_rate(spark, sf_dir):
    (found,) = d.truncation(t.tables(spark, sf_dir))
    return shown(found.rows, "workflow", "step", "model", more=("near_context_limit", "repaired"))


def top_sql(source: str, column: str, metric: str) -> str:
    return f"""s AS (SELECT workflow, step, sum({column}) AS amount, count(*) AS n, count(*) FILTER (WHERE coalesce({column}, 0) <> 0) AS hits, min(epoch_us(start_time)) FILTER (WHERE coalesce({column}, 0) <> 0) AS first_us,
 max(epoch_us(start_time)) FILTER (WHERE coalesce({column}, 0) <> 0) AS last_us FROM {source} GROUP BY workflow, step),
r AS (SELECT *, amount / sum(amount) OVER w AS share, sum(n) OVER w AS total, count(amount) OVER w AS steps, row_number() OVER (PARTITION BY workflow ORDER BY amount DESC NULLS LAST) AS k FROM s WINDOW w AS (PARTITION BY workflow))
SELECT workflow, step, '{metric}' AS metric, hits, CAST(total AS BIGINT) AS total, round(share, 6) AS value, 'low' AS severity, 'cost' AS category, first_us, last_us, round(1 / steps, 6) AS baseline FROM r WHERE k = 1 AND steps >= 2 AND share >= greatest(0.5, 1.5 / steps)"""


@query(f"WITH {STEPS}, " + top_sql("(SELECT * FROM steps WHERE executed = 1)", "latency_ms", "time_share"))
def time_share(spark, sf_dir):
    found = d.top_share(t.steps(spark, sf_dir).filter("executed = 1"), "duration_ms", "time_share")
    return shown(found.rows, "workflow", "step", more=(r6(F.col("baseline"), "baseline"),))


@query(f"WITH {CALLS}, " + top_sql("calls", "cost_usd", "cost_share"))
def cost_share(spark, sf_dir):
    found = d.top_share(d.own_calls(t.tables(spark, sf_dir)), "cost_usd", "cost_share")
    return shown(found.rows, "workflow", "step", more=(r6(F.col("baseline"), "baseline"),))


@query(f"""WITH {CALLS}, m AS (SELECT workflow, step, scorer, prompt_version, quantile_cont(input_tokens, 0.5) AS median, min((start_time, span_id)) AS seen, count(*) AS hits, min(epoch_us(start_time)) AS first_us, max(epoch_us(start_time)) AS last_us FROM calls GROUP BY ALL),
l AS (SELECT *, lag(prompt_version) OVER w AS before, lag(median) OVER w AS baseline, sum(hits) OVER (PARTITION BY workflow, step, scorer) AS total FROM m WINDOW w AS (PARTITION BY workflow, step, scorer ORDER BY seen))
SELECT workflow, step, scorer, prompt_version, 'median_input_tokens' AS metric, hits, CAST(total AS BIGINT) AS total, round(CAST(median AS DOUBLE), 6) AS value, CASE WHEN median / baseline - 1 >= 1 THEN 'medium' ELSE 'low' END AS severity, 'cost' AS category, first_us, last_us, round(CAST(baseline AS DOUBLE), 6) AS baseline, before
FROM l WHERE baseline > 0 AND median / baseline - 1 >= 0.5""")
def token_growth(spark, sf_dir):
    return shown(
        d.token_growth(t.tables(spark, sf_dir)).rows, "workflow", "step", "scorer", "prompt_version",
        more=(r6(F.col("baseline"), "baseline"), "before")
    )


@query(f"""WITH {CALLS}, c AS (SELECT *, coalesce(lower(error) LIKE '%out of memory%', false) AS oom FROM calls), g AS (SELECT workflow, count(*) FILTER (WHERE swap) AS swaps, count(DISTINCT run_id) AS runs, count(*) FILTER (WHERE oom) AS oom_errors, max(vram) AS vram_peak_mb,
 coalesce(quantile_cont(lease_wait_ms, 0.5), 0) AS wait, count(*) AS total, count(*) FILTER (WHERE swap OR oom OR coalesce(lease_wait_ms, 0) >= 1000) AS hits, min(epoch_us(start_time)) FILTER (WHERE swap OR oom OR coalesce(lease_wait_ms, 0) >= 1000) AS first_us,
 max(epoch_us(start_time)) FILTER (WHERE swap OR oom OR coalesce(lease_wait_ms, 0) >= 1000) AS last_us FROM c GROUP BY workflow)
SELECT workflow, 'model_swaps_per_run' AS metric, hits, total, round(swaps / runs, 6) AS value, CASE WHEN oom_errors > 0 OR swaps / runs >= 1 THEN 'high' ELSE 'medium' END AS severity, 'cost' AS category, first_us, last_us, swaps, runs, oom_errors, round(wait, 6) AS wait, vram_peak_mb FROM g WHERE swaps / runs >= 0.5 OR wait >= 1000 OR oom_errors > 0""")
def swaps_per_run(spark, sf_dir):
    (found,) = d.gpu_thrash(t.tables(spark, sf_dir))
    return shown(found.rows, "workflow", more=("swaps", "runs", "oom_errors", r6(F.col("median_lease_wait_ms"), "wait"), "vram_peak_mb"))


@query(f"""WITH {CALLS}, c AS (SELECT workflow, run_id, start_time, lease_wait_ms FROM calls WHERE coalesce(lease_wait_ms, 0) >= 60 AND NOT swap), g AS (SELECT workflow, count(*) AS n, quantile_cont(lease_wait_ms, 0.5) AS wait, count(DISTINCT run_id) AS runs FROM c GROUP BY workflow)
SELECT workflow, CAST(0 AS BIGINT) AS swaps, round(wait, 6) AS wait, n AS hits FROM g WHERE wait >= 60""")
def slow_leases(spark, sf_dir):
    """Slow leases alone are a finding too."""
    slow = d.own_calls(t.tables(spark, sf_dir)).filter("lease_wait_ms >= 60 AND gpu_unloaded = 0").withColumn("error", F.lit(None).cast("string"))
    (found,) = d.gpu_thrash({"calls": slow}, slow_ms=60.0)
    return found.rows.select("workflow", "swaps", r6(F.col("median_lease_wait_ms"), "wait"), "hits")


RUN_CALLS = "rc AS (SELECT CAST(o_orderkey AS VARCHAR) AS span_id, 'r' || (o_custkey * 3 + o_orderkey % 3) AS run_id, o_orderpriority AS workflow, o_orderdate AS start_time, CASE WHEN o_orderkey % 6 = 0 THEN 'p' || (o_orderkey % 3) END AS stale FROM orders)"


@query(f"""WITH {RUN_CALLS}, r AS (SELECT workflow, run_id, count(*) > 1 OR count(stale) > 0 AS resumed FROM rc GROUP BY ALL), n AS (SELECT workflow, count(*) FILTER (WHERE resumed) AS total FROM r GROUP BY workflow),
f AS (SELECT workflow, stale AS step, run_id, min(epoch_us(start_time)) AS at1 FROM rc WHERE stale IS NOT NULL GROUP BY ALL), h AS (SELECT workflow, step, count(*) AS hits, min(at1) AS first_us, max(at1) AS last_us FROM f GROUP BY ALL)
SELECT h.workflow, step, 'stale_source_rate' AS metric, hits, total, round(hits / total, 6) AS value, CASE WHEN hits / total >= 0.05 THEN 'high' WHEN hits / total >= 0.01 THEN 'medium' ELSE 'low' END AS severity, 'reliability' AS category, first_us, last_us FROM h JOIN n ON h.workflow = n.workflow""")
def stale_source_rate(spark, sf_dir):
    (found,) = d.reuse_health(t.tables(spark, sf_dir))
    return shown(found.rows, "workflow", "step")


LEVELS = f"""{SELECTIONS}, sc AS (SELECT * FROM selections WHERE kind = 'score'), b AS (SELECT workflow, scorer, count(value) AS n, count(DISTINCT value) FILTER (WHERE value > 0) AS levels, min(value) FILTER (WHERE value > 0) AS least FROM sc GROUP BY ALL),
nl AS (SELECT s.workflow, s.scorer, count(*) AS total, count(*) FILTER (WHERE s.value = 0) AS zeros, count(*) FILTER (WHERE CASE WHEN levels BETWEEN 1 AND 10 AND n >= 2 * (levels + 1) THEN s.value = least ELSE s.value > 0 AND s.value < 0.2 END) AS next_level FROM sc s JOIN b ON s.workflow = b.workflow AND s.scorer = b.scorer GROUP BY ALL),
sp AS (SELECT * FROM nl WHERE zeros > 0 AND next_level < zeros / 2.0)"""


@query(f"WITH {LEVELS} SELECT workflow, scorer, total, zeros, next_level, zeros > 0 AND next_level < zeros / 2.0 AS spike FROM nl")
def zero_spike(spark, sf_dir):
    return d.next_level(t.tables(spark, sf_dir)).select("workflow", "scorer", "total", "zeros", "next_level", "spike")


@query(
    f"WITH {SELECTIONS} " + rate_sql(
        "(SELECT * FROM selections WHERE kind = 'score')", "workflow, scorer",
        [("none_score_rate", "value IS NULL", 0.05, 0.5, 0.05)]
    )
)
def none_score_rate(spark, sf_dir):
    return shown(d.missing_scores(t.tables(spark, sf_dir)).rows, "workflow", "scorer")


ANSWERED = r"(coalesce(reason, '') <> '' AND confidence IS NOT NULL AND coalesce(error, '') = '' AND NOT regexp_matches(coalesce(reason, ''), '(?i)^\W*(error|exception|failed)\b'))"
ZEROS = rate_sql(
    "zs", "workflow, scorer",
    [("zero_score_rate", f"value = 0 AND NOT {ANSWERED}", 0.05, 0.1, 0.05), ("floor_score_rate", f"value = 0 AND {ANSWERED}", 0.05, 0.3, 0.1)],
    category="quality"
)


@query(f"""WITH {CALLS}, {LEVELS}, zs AS (SELECT sc.* FROM sc JOIN sp ON sc.workflow = sp.workflow AND sc.scorer = sp.scorer), z AS ({ZEROS}),
q AS (SELECT workflow, scorer, list(reason ORDER BY start_time, span_id)[1:3] AS reasons FROM zs WHERE value = 0 AND {ANSWERED} GROUP BY ALL), f AS (SELECT workflow, scorer, count(*) AS failed FROM calls_all WHERE structured_path = 'failed' GROUP BY ALL)
SELECT z.*, CASE WHEN metric = 'floor_score_rate' THEN array_to_string(reasons, '|') END AS reasons, CASE WHEN metric = 'zero_score_rate' THEN coalesce(failed, 0) ELSE -1 END AS failed_judge_calls FROM z LEFT JOIN q ON z.workflow = q.workflow AND z.scorer = q.scorer LEFT JOIN f ON z.workflow = f.workflow AND z.scorer IS NOT DISTINCT FROM f.scorer""".replace("calls_all", "calls"))
def zero_scores(spark, sf_dir):
    tables = t.tables(spark, sf_dir)
    rows = d.zero_scores(tables | {"calls": d.own_calls(tables)}).rows
    return shown(
        rows, "workflow", "scorer",
        more=(
            F.array_join("sample_reasons", "|").alias("reasons"),
            F.coalesce("failed_judge_calls", F.lit(-1)).cast("long").alias("failed_judge_calls")
        )
    )


@query(
    f"WITH {SELECTIONS} " + rate_sql(
        "(SELECT * FROM selections WHERE kind = 'gate')", "workflow, gate",
        [("gate_rejection_rate", "passed = 0", 0.5, 0.5, 0.5)], category="quality"
    )
)
def gate_rejection_rate(spark, sf_dir):
    return shown(d.gate_rejections(t.tables(spark, sf_dir)).rows, "workflow", "gate")


@query(
    f"WITH {SELECTIONS} " + rate_sql(
        "(SELECT * FROM selections WHERE kind = 'decision')", "workflow",
        [("fallback_rate", "fallback_used = 1", 0.1, 0.5, 0.1), ("low_margin_rate", "margin <> 0 AND margin < 0.02", 0.3, 0.5, 0.3)],
        category="quality"
    )
)
def decision_rates(spark, sf_dir):
    return shown(d.decisions(t.tables(spark, sf_dir)).rows, "workflow")


@query(
    f"""WITH {SELECTIONS}, c AS (SELECT workflow, candidate_id, count(DISTINCT scorer) AS n, max(value) - min(value) AS spread, min((start_time, span_id)) AS f FROM selections WHERE kind = 'score' AND value IS NOT NULL GROUP BY ALL), m AS (SELECT workflow, spread, f[1] AS start_time FROM c WHERE n > 1) """ + rate_sql(
        "m", "workflow", [("judge_disagreement_rate", "spread > 0.5", 0.2, 0.5, 0.2)], category="quality"
    )
)
def disagreement(spark, sf_dir):
    return shown(d.judge_disagreement(t.tables(spark, sf_dir)).rows, "workflow")


REVIEWS = f"{SELECTIONS}, rv AS (SELECT *, lower(decision) AS said FROM selections WHERE kind = 'human_gate' AND decision IS NOT NULL)"
OVERRIDE = "said IN ('reject', 'rejected', 'edit', 'edited', 'overrule', 'overruled')"


@query(
    f"WITH {REVIEWS} " + rate_sql(
        "(SELECT * FROM rv WHERE actor_kind IS DISTINCT FROM 'automated')", "workflow, step, gate",
        [("override_rate", OVERRIDE, 0.2, 0.4, 0.2)], category="quality", where="total >= 5"
    )
)
def override_rate(spark, sf_dir):
    return shown(d.overrides(t.tables(spark, sf_dir)).rows, "workflow", "step", "gate")


@query(f"""WITH {REVIEWS}, i AS (SELECT workflow, step, gate, run_id, item, count(*) FILTER (WHERE {OVERRIDE}) AS rounds, max(start_time) FILTER (WHERE said IN ('approve', 'approved')) AS start_time FROM rv WHERE actor_kind = 'automated' GROUP BY ALL),
j AS (SELECT * FROM i WHERE start_time IS NOT NULL), a AS ({rate_sql("j", "workflow, step, gate", [("automated_rework_rate", "rounds > 0", 0.2, 1.1, 0.5)], category="quality", more="round_even(avg(rounds), 2) AS mean_rounds ;; max(rounds) AS max_rounds")}),
h AS (SELECT workflow, step, gate, string_agg(rounds || ':' || n, ',' ORDER BY rounds) AS histogram FROM (SELECT workflow, step, gate, rounds, count(*) AS n FROM j GROUP BY ALL) GROUP BY ALL)
SELECT a.*, histogram FROM a JOIN h USING (workflow, step, gate)""")
def automated_rework(spark, sf_dir):
    rows = d.automated_rework(t.tables(spark, sf_dir)).rows
    entries = F.array_sort(F.transform(F.map_entries("rounds_until_approved"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v"))))
    histogram = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["k"].cast("string"), e["v"].cast("string"))), ",")
    return shown(rows, "workflow", "step", "gate", more=("mean_rounds", "max_rounds", histogram.alias("histogram")))


FLOW = f"""{EVENT_K}, fs AS (SELECT CAST(user_id AS VARCHAR) AS run_id, 'flow-' || (user_id % 3) AS workflow, CAST(k % 10 AS VARCHAR) AS step, CASE WHEN k % 6 > 0 THEN CAST(k % 5 AS VARCHAR) END AS item, CASE WHEN k % 4 = 0 THEN 'gate' WHEN k % 4 = 1 THEN 'step' END AS kind,
 CASE WHEN k % 5 = 0 THEN 0 ELSE k % 3 + 1 END AS attempt, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_rejected, k % 13 = 0 AS reused, ts AS start_time, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'a' ELSE 'p' END END AS r1, CASE WHEN k % 9 = 0 THEN 'a' END AS r2 FROM ek),
auto AS (SELECT run_id, item FROM (SELECT run_id, item, unnest([r1, r2]) AS r FROM fs WHERE kind = 'gate') WHERE r IS NOT NULL GROUP BY ALL HAVING bool_and(r = 'a')),
es AS (SELECT 's' || event_id AS span_id, CAST(user_id AS VARCHAR) AS run_id, CAST(k % 8 AS VARCHAR) AS step, CAST(k % 5 AS VARCHAR) AS item, ts AS start_time FROM ek),
latest AS (SELECT run_id, step, item, arg_max(span_id, (start_time, span_id)) AS latest FROM es GROUP BY ALL),
rr AS (SELECT fs.workflow, fs.step, fs.run_id, fs.start_time, coalesce(latest, fs.run_id || '/' || fs.step || '/' || coalesce(fs.item, '')) AS span_id, CASE WHEN auto.run_id IS NOT NULL THEN 0 ELSE n_rejected END AS rejected
 FROM fs LEFT JOIN latest l ON l.run_id = fs.run_id AND l.step = fs.step AND l.item IS NOT DISTINCT FROM fs.item LEFT JOIN auto ON auto.run_id = fs.run_id AND auto.item IS NOT DISTINCT FROM fs.item WHERE fs.kind IS DISTINCT FROM 'gate' AND NOT reused AND attempt >= 1)"""


@query(f"WITH {FLOW} SELECT run_id, item FROM auto")
def sent_back_by_scripts(spark, sf_dir):
    return d.sent_back_by_scripts(t.flow_steps(spark, sf_dir))


@query(f"WITH {FLOW} SELECT workflow, step, run_id, epoch_us(start_time) AS at_us, span_id, CAST(rejected AS INTEGER) AS rejected FROM rr")
def revision_evidence(spark, sf_dir):
    return d.revision_rows(t.tables(spark, sf_dir)).select("workflow", "step", "run_id", us("start_time", "at_us"), "span_id", "rejected")


@query(
    f"WITH {FLOW} " + rate_sql(
        "rr", "workflow, step", [("revision_rate", "rejected > 0", 0.2, 0.4, 0.2)], category="quality",
        more="CAST(sum(rejected) AS BIGINT) AS revisions ;; CAST(max(rejected) AS INTEGER) AS max_revisions"
    )
)
def revision_rate(spark, sf_dir):
    return shown(d.revisions(t.tables(spark, sf_dir)).rows, "workflow", "step", more=("revisions", "max_revisions"))


@query(f"""WITH {CALLS}, f AS (SELECT *, regexp_extract(lower(string_split(model, '/')[-1]), '^([^-:]*)', 1) AS family FROM calls), j AS (SELECT workflow, scorer, model, family, count(*) AS total, min(epoch_us(start_time)) AS first_us, max(epoch_us(start_time)) AS last_us FROM f WHERE scorer IS NOT NULL GROUP BY ALL)
SELECT workflow, scorer, model, 'same_family_judge_share' AS metric, total AS hits, total, 1.0::DOUBLE AS value, 'medium' AS severity, 'setup' AS category, first_us, last_us FROM j WHERE EXISTS (SELECT 1 FROM f WHERE f.workflow = j.workflow AND f.family = j.family AND f.scorer IS NULL)""")
def same_family_judge(spark, sf_dir):
    return shown(d.same_family_judge(t.tables(spark, sf_dir)).rows, "workflow", "scorer", "model")


CAPABILITY = r"status = 'error' AND regexp_matches(error, '(?i)\b400\b|not support|unsupported|capabilit')"


@query(
    f"WITH {CALLS} " + rate_sql(
        "calls", "workflow, scorer, model", [("capability_error_rate", CAPABILITY, 0.0, 0.0, 0.0)], category="setup",
        more=f"arg_min(error, (start_time, span_id)) FILTER (WHERE {CAPABILITY}) AS first_error"
    )
)
def capability_error_rate(spark, sf_dir):
    return shown(d.capability_errors(t.tables(spark, sf_dir)).rows, "workflow", "scorer", "model", more=("first_error",))


SEEDED = f"{EVENT_K}, seeded AS (SELECT DISTINCT run_id FROM (SELECT 'r' || (o_custkey * 3 + o_orderkey % 3) AS run_id FROM orders WHERE o_orderkey % 5 = 0 UNION SELECT CAST(user_id AS VARCHAR) FROM ek WHERE user_id % 7 = 0 UNION SELECT CAST(user_id AS VARCHAR) FROM ek WHERE user_id % 11 = 0))"


@query(f"WITH {SEEDED} SELECT run_id FROM seeded")
def seeded_runs(spark, sf_dir):
    return d.seeded_runs(t.tables(spark, sf_dir))


@query(f"""WITH {CALLS}, {SEEDED}, p AS (SELECT DISTINCT 'flow-' || (user_id % 3) AS workflow, CAST(k % 8 AS VARCHAR) AS step FROM ek WHERE k % 8 = 2), c AS (SELECT calls.*, seed IS NOT NULL AND seeded.run_id IS NULL AND p.step IS NULL AS can FROM calls LEFT JOIN seeded ON seeded.run_id = calls.run_id LEFT JOIN p ON p.workflow = calls.workflow AND p.step = calls.step),
g AS (SELECT workflow, step, model, CASE WHEN can THEN input_sha END AS sha, count(DISTINCT seed) > 1 AND any_value(can) AS varied, count(*) AS n, min(epoch_us(start_time)) AS first_us, max(epoch_us(start_time)) AS last_us FROM c GROUP BY workflow, step, model, CASE WHEN can THEN input_sha END),
o AS (SELECT workflow, step, model, CAST(coalesce(sum(n) FILTER (WHERE varied AND sha IS NOT NULL), 0) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total, min(first_us) FILTER (WHERE varied AND sha IS NOT NULL) AS first_us, max(last_us) FILTER (WHERE varied AND sha IS NOT NULL) AS last_us FROM g GROUP BY ALL)
SELECT workflow, step, model, 'unseeded_repeat_rate' AS metric, hits, total, round(hits / total, 6) AS value, 'low' AS severity, 'setup' AS category, first_us, last_us FROM o WHERE hits >= 3""")
def unseeded_repeats(spark, sf_dir):
    return shown(d.unseeded_repeats(t.tables(spark, sf_dir)).rows, "workflow", "step", "model")


@query(f"""WITH {CALLS}, h AS (SELECT workflow, step, model, scorer, prompt_version, span_id, run_id, start_time FROM calls WHERE status = 'error'), g AS (SELECT {CALL_KEYS}, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS hits FROM calls GROUP BY ALL), f AS (SELECT * FROM g WHERE hits >= 3 AND hits / total >= 0.01),
a AS (SELECT h.* FROM h JOIN f ON h.workflow = f.workflow AND h.step = f.step AND h.model = f.model AND h.scorer IS NOT DISTINCT FROM f.scorer AND h.prompt_version = f.prompt_version),
r AS (SELECT *, row_number() OVER (PARTITION BY {CALL_KEYS} ORDER BY start_time, span_id) - 1 AS k, count(*) OVER (PARTITION BY {CALL_KEYS}) AS n FROM a), i AS (SELECT *, (k * 20 + n - 1) // n AS i FROM r) SELECT {CALL_KEYS}, span_id, run_id FROM i WHERE n <= 20 OR (i < 20 AND (i * n) // 20 = k)""")
def affected_evidence(spark, sf_dir):
    """The rows behind the findings, and the sample of them that a finding shows."""
    keys = CALL_KEYS.split(", ")
    rows = d.call_failures(t.tables(spark, sf_dir)).affected().filter("metric = 'error_rate'")
    return evidence(rows, keys).select(*keys, "span_id", "run_id")


@query(f"WITH {CALLS} SELECT run_id, arg_max(prompt_version, (start_time, span_id)) AS prompt_version FROM calls WHERE scorer IS NULL GROUP BY run_id")
def prompt_of_run(spark, sf_dir):
    return d.prompt_of_run(t.tables(spark, sf_dir))


FINDINGS = f"""WITH {CALLS}, r AS ({rate_sql("calls", CALL_KEYS, [("error_rate", "status = 'error'", 0.01, 0.2, 0.05), ("retry_rate", "retries > 0", 0.01, 0.2, 0.05)])}),
k AS (SELECT *, substr(sha256('["failure_rate", "reliability", {{"model": "' || model || '", "prompt_version": "' || prompt_version || '", ' || CASE WHEN scorer IS NOT NULL THEN '"scorer": "' || scorer || '", ' ELSE '' END || '"step": "' || step || '", "workflow": "' || workflow || '"}}, "' || metric || '"]'), 1, 24) AS key,
 round(hits / total * CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, 6) AS impact FROM r)
SELECT key, metric, hits AS affected, total, severity, impact FROM k"""


@query(FINDINGS)
def finding_keys(spark, sf_dir):
    """Rows of a detector as findings: content keys and impacts."""
    rows = d.call_failures(t.tables(spark, sf_dir)).rows.filter("metric <> 'repair_rate'")
    found = fs.ranked(fs.from_rows("failure_rate", "reliability", [r.asDict() for r in rows.collect()]))
    made = [(f.key, f.metric, f.affected, f.total, f.severity, round(f.impact, 6)) for f in found]
    return spark.createDataFrame(made, "key string, metric string, affected long, total long, severity string, impact double")
