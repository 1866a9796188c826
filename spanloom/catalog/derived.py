"""Normalization and derivation, on conversations seen as raw spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog.base import query, us
from spanloom.functions import scalars
from spanloom.plans import testbed as t
from spanloom.plans.derive import attribute, depths, derive, step_ancestors
from spanloom.plans.normalize import normalize
from spanloom.streaming.ingest import rates_by_window

#: The conversations' spans in SQL: ids as the testbed makes them, context as derivation finds it.
C = """c AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS n, lpad(lower(hex(conv_id + 1)), 32, '0') AS trace_id, (1700000000 + (conv_id * 1000 + turn) * 10) * 1000000 AS at_us, 'run-' || conv_id AS run_id, 't' || (turn % 3) AS step, CAST(turn AS VARCHAR) AS item,
 CASE WHEN conv_id % 4 > 0 THEN 'wf' || (conv_id % 4) ELSE 'svc' END AS workflow, (conv_id * 1000 + turn) % 4 AS shape FROM conversations)"""


def sid(number: int) -> str:
    return f"lpad(lower(hex(n * 10 + {number})), 16, '0')"


CONTEXT = "trace_id, run_id, workflow, step, item, at_us"


def context(df):
    return df.withColumn("at_us", F.unix_micros("start_time")).drop("start_time")


def _derived(spark, sf_dir):
    return derive(normalize(t.raw_spans(spark, sf_dir)))


STATUS = "CASE WHEN turn % 6 = 3 THEN 'error' WHEN turn % 6 = 1 THEN 'ok' ELSE 'unset' END"


@query(f"""WITH {C} SELECT {sid(3)} AS span_id, {CONTEXT}, CASE WHEN shape = 1 THEN 'served' ELSE 'm' || (turn % 2) END AS model, 'prov' AS provider, CASE WHEN turn % 5 = 4 THEN 'judge' END AS scorer, CAST(turn % 2 + 1 AS VARCHAR) AS template_version,
 CAST(CASE WHEN shape = 3 THEN 0 ELSE 1 END AS INTEGER) AS retries, CASE WHEN shape = 0 THEN 'length' END AS finish_reason, CASE WHEN shape = 2 THEN 7 ELSE length(text) END AS input_tokens, 0.5::DOUBLE AS temperature, CASE WHEN shape = 3 THEN n ELSE -1 END AS seed,
 CASE WHEN text <> '' THEN sha256(text) END AS input_sha, 3000.0::DOUBLE AS latency_ms, CAST(CASE shape WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE -1 END AS INTEGER) AS gpu_unloaded, {STATUS} AS status, CASE WHEN turn % 6 = 3 THEN 'boom' END AS error FROM c WHERE role = 'user'
UNION ALL SELECT {sid(7)}, trace_id, trace_id, workflow, 'wrapper', NULL, at_us, 'plain', NULL, NULL, NULL, 0, NULL, -1, NULL, -1, NULL, 2000.0, -1, 'ok', NULL FROM c WHERE turn % 7 = 1 AND role = 'user'
UNION ALL SELECT {sid(7)}, trace_id, trace_id, workflow, NULL, NULL, at_us, 'plain', NULL, NULL, NULL, 0, NULL, -1, NULL, -1, NULL, 2000.0, -1, 'ok', NULL FROM c WHERE turn % 7 = 1 AND role <> 'user'""")
def derived_calls(spark, sf_dir):
    wanted = [
        "span_id", "trace_id", "run_id", "workflow", "step", "item", "at_us", "model", "provider", "scorer", "template_version",
        "retries", "finish_reason", "input_tokens", "temperature", "seed", "input_sha", "latency_ms", "gpu_unloaded", "status",
        "error"
    ]
    rows = context(_derived(spark, sf_dir)["calls"])
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("input_tokens", "seed", "gpu_unloaded")}).select(*wanted)


@query(f"""WITH {C}, s AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'failed' WHEN turn % 4 = 1 THEN 'skipped' ELSE 'ok' END AS st FROM c) SELECT {sid(1)} AS span_id, {CONTEXT}, '2' AS step_version, st AS status, CAST(CASE WHEN st IN ('failed', 'ok') AND turn % 4 <> 2 THEN 1 ELSE 0 END AS INTEGER) AS executed,
 CASE WHEN turn % 4 = 2 THEN 'old' END AS reused_from, CASE WHEN conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) THEN 'f' END AS fork_of, CASE WHEN turn % 2 = 0 THEN '3' END AS size, 2000.0::DOUBLE AS duration_ms FROM s
UNION ALL SELECT {sid(5)}, {CONTEXT}, NULL, 'ok', 1, NULL, CASE WHEN conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) THEN 'f' END, NULL, 2000.0 FROM c WHERE turn % 3 = 0 AND turn % 2 = 1""")
def derived_steps(spark, sf_dir):
    rows = context(_derived(spark, sf_dir)["steps"]).withColumn("size", F.try_element_at("params", F.lit("size")))
    return rows.select(
        "span_id", "trace_id", "run_id", "workflow", "step", "item", "at_us", "step_version", "status", "executed", "reused_from",
        "fork_of", "size", "duration_ms"
    )


@query(f"""WITH {C} SELECT {sid(4)} AS span_id, {CONTEXT}, 'score' AS kind, CASE WHEN turn % 2 = 1 THEN 'c1' ELSE 'c0' END AS candidate_id, 's' AS scorer, (turn % 5) / 4 AS value, CASE WHEN turn % 3 = 0 THEN '(not captured, 8 chars)' WHEN turn % 3 = 1 THEN 'fine' END AS reason,
 NULL AS gate, NULL AS decision, NULL AS actor_kind, CAST(-1 AS INTEGER) AS fallback_used, NULL AS ranked FROM c WHERE turn % 2 = 1
UNION ALL SELECT {sid(5)}, {CONTEXT}, 'human_gate', NULL, NULL, NULL, NULL, step, 'rejected', CASE WHEN turn % 4 = 0 THEN 'automated' END, -1, NULL FROM c WHERE turn % 3 = 0 AND turn % 2 = 0
UNION ALL SELECT {sid(6)}, {CONTEXT}, 'decision', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN turn % 2 = 0 THEN 'a=0.5,b=0.25' ELSE 'a=0.5' END FROM c WHERE turn % 5 = 0""")
def derived_selections(spark, sf_dir):
    ranked = F.array_join(F.transform("ranked", lambda r: F.concat_ws("=", r["id"], r["total"].cast("string"))), ",")
    rows = context(_derived(spark, sf_dir)["selections"]).withColumns({"ranked": ranked, "fallback_used": F.coalesce("fallback_used", F.lit(-1))})
    return rows.select(
        "span_id", "trace_id", "run_id", "workflow", "step", "item", "at_us", "kind", "candidate_id", "scorer", "value", "reason",
        "gate", "decision", "actor_kind", "fallback_used", "ranked"
    )


@query(
    f"""WITH {C} SELECT {sid(3)} AS span_id, {CONTEXT}, {sid(1)} AS step_span_id, CASE WHEN shape = 1 THEN 'served' ELSE 'm' || (turn % 2) END AS model, CAST(turn % 2 + 1 AS VARCHAR) AS template_version, '> ' || text AS text, sha256('> ' || text) AS text_sha FROM c WHERE role = 'user' AND turn % 3 > 0 AND turn % 5 <> 4"""
)
def derived_outputs(spark, sf_dir):
    """The step above an output is two spans up: a wrapper lies between."""
    return context(_derived(spark, sf_dir)["outputs"])


@query(
    f"""WITH {C} SELECT {sid(0)} AS span_id, {CONTEXT}, 'ok' AS status, CASE WHEN conv_id % 3 = 0 THEN 'f' END AS fork_of, CASE WHEN conv_id % 2 = 0 THEN 9 ELSE -1 END AS seed, 'k@t0' AS warnings FROM c WHERE turn = 0"""
)
def derived_run_calls(spark, sf_dir):
    warnings = F.array_join(F.transform("warnings", lambda w: F.concat_ws("@", w["kind"], w["step"])), ",")
    return context(_derived(spark, sf_dir)["run_calls"]).withColumns({"warnings": warnings, "seed": F.coalesce(F.col("seed").cast("int"), F.lit(-1))}).select(
        "span_id", "trace_id", "run_id", "workflow", "step", "item", "at_us", "status", "fork_of", "seed", "warnings"
    )


@query(
    f"""WITH {C} SELECT {sid(3)} AS span_id, text AS prompt, 'prov' AS provider, CASE WHEN shape = 2 THEN '7' ELSE CAST(length(text) AS VARCHAR) END AS input_tokens, {STATUS} AS status, false AS old_names, at_us, strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM c WHERE role = 'user'"""
)
def normalized_calls(spark, sf_dir):
    """Messages of four shapes (lists, pieces, indexed attributes, events) read alike; old names are gone."""
    spans = normalize(t.raw_spans(spark, sf_dir)).filter("name = 'hone.models.chat'")
    old = F.map_contains_key("attributes", F.lit("gen_ai.system")) | F.map_contains_key("attributes", F.lit("gen_ai.usage.prompt_tokens"))
    return spans.select(
        "span_id", scalars.messages_text(attribute("gen_ai.input.messages")).alias("prompt"),
        attribute("gen_ai.provider.name").alias("provider"), attribute("gen_ai.usage.input_tokens").alias("input_tokens"),
        F.col("status.code").alias("status"), old.alias("old_names"), us("start_time", "at_us"),
        scalars.iso(F.col("start_time")).alias("iso")
    )


@query(
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'ok' ELSE 'unset' END AS code, CASE WHEN event_id % 2 = 0 THEN lpad(lower(hex(event_id)), 16, '0') ELSE sha256('e' || event_id)[1:16] END AS id, CASE WHEN event_id % 3 = 0 THEN 'stop' END AS reason, sha256(event_type) AS sha, json_extract_string(props, '$.k') AS k, CAST(CASE WHEN event_id % 3 = 1 THEN 0 WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS listed, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events"
)
def scalar_functions(spark, sf_dir):
    """Statuses, ids, finish reasons and hashes of texts."""
    status = F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").when(F.col("event_type") == "click", "1").otherwise(F.col("event_type"))
    raw_id = F.when(F.col("event_id") % 2 == 0, F.lpad(F.hex("event_id"), 16, "0")).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    reasons = F.when(F.col("event_id") % 3 == 0, '["stop", "x"]').when(F.col("event_id") % 3 == 1, "stop").otherwise("[]")
    return t.table(spark, sf_dir, "events").select(
        "event_id", scalars.status_code(status).alias("code"), scalars.hex_id(raw_id, 16).alias("id"),
        scalars.finish_reason(reasons).alias("reason"), scalars.text_sha(F.col("event_type")).alias("sha"),
        F.try_element_at(scalars.json_map(F.col("props")), F.lit("k")).alias("k"),
        F.size(scalars.json_list(reasons)).alias("listed"),
        scalars.canonical_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("at")
    )


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS messages FROM conversations GROUP BY conv_id")
def message_text(spark, sf_dir):
    by = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.count(F.lit(1)).alias("messages")
    )
    as_json = F.to_json(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))))
    return by.select("conv_id", scalars.messages_text(as_json).alias("text"), "messages")


def _chain(spark, sf_dir):
    parent = F.when(F.col("event_id") % 700 != 0, F.col("event_id") - 1).cast("string")
    return t.table(spark, sf_dir, "events").select(
        F.lit("t").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), parent.alias("parent_span_id"),
        (F.col("event_id") % 350 == 0).alias("is_step")
    )


@query(
    """WITH s AS (SELECT event_id - max(event_id) FILTER (WHERE event_id % 700 = 0) OVER (ORDER BY event_id) AS depth FROM events) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS spans FROM s GROUP BY depth"""
)
def trace_depth(spark, sf_dir):
    """Chains of 700 spans."""
    return depths(_chain(spark, sf_dir).drop("is_step")).groupBy(F.col("depth").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("spans"))


@query("""SELECT CAST(event_id AS VARCHAR) AS span_id, CAST((event_id - 1) // 350 * 350 AS VARCHAR) AS step_span_id FROM events WHERE event_id % 700 <> 0""")
def nearest_step(spark, sf_dir):
    return step_ancestors(_chain(spark, sf_dir)).select("span_id", "step_span_id")


@query(
    """SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type AS step, count(*) AS total, count(*) FILTER (WHERE value > 100) AS hits FROM events GROUP BY ALL"""
)
def rates_per_window(spark, sf_dir):
    """The plan that the stream runs, over a table."""
    rows = t.table(spark, sf_dir, "events").select(
        F.col("ts").alias("start_time"), F.col("event_type").alias("step"), F.when(F.col("value") > 100, "error").alias("status")
    )
    return rates_by_window(rows).select(us("window.start", "hour_us"), "step", "total", "hits")
