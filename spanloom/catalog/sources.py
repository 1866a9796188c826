"""Sources: the driver's rows written in each source's format and read back through it."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog.base import query, us
from spanloom.catalog.derived import STATUS, C, sid
from spanloom.plans import testbed as t
from spanloom.plans.derive import attribute, derive
from spanloom.plans.normalize import normalize
from spanloom.scratch import own_dir
from spanloom.sources.registry import open_source, step_records
from spanloom.testing.fakes import FakeHistory, FakeSource
from spanloom.testing.writers import write_store
from spanloom.workspace import Workspace


def fresh(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """``df`` (value) as text files."""
    path = fresh(df.sparkSession, name)
    df.write.text(path)
    return path


def span_json(spans: DataFrame) -> DataFrame:
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), time(e["time"]).alias("time"), e["attributes"].alias("attributes")))
    return spans.withColumns({"start_time": time("start_time"), "end_time": time("end_time"), "events": events}).select(F.to_json(F.struct("*")).alias("value"))


COUNTS = f"""WITH {C}, s AS (SELECT trace_id, at_us FROM c UNION ALL SELECT trace_id, at_us FROM c WHERE turn = 0 UNION ALL SELECT trace_id, at_us FROM c WHERE role = 'user' UNION ALL SELECT trace_id, at_us FROM c WHERE role = 'user' UNION ALL SELECT trace_id, at_us FROM c WHERE turn % 2 = 1
 UNION ALL SELECT trace_id, at_us FROM c WHERE turn % 3 = 0 UNION ALL SELECT trace_id, at_us FROM c WHERE turn % 5 = 0 UNION ALL SELECT trace_id, at_us FROM c WHERE turn % 7 = 1)"""
SUMMARY = "SELECT trace_id, count(*) AS spans, min(at_us) AS first_us, max(at_us) AS last_us FROM s GROUP BY trace_id"


def summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"), F.unix_micros(F.min("start_time")).alias("first_us"),
        F.unix_micros(F.max("start_time")).alias("last_us")
    )


@query(f"{COUNTS} {SUMMARY}")
def span_lines(spark, sf_dir):
    path = fresh(spark, "lines")
    span_json(t.raw_spans(spark, sf_dir)).write.format("text").option("compression", "none").save(path)
    jsonl = f"{path}-in"
    storage = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    storage.mkdirs(as_path(jsonl))
    for status in storage.listStatus(as_path(path)):
        if status.getPath().getName().startswith("part-"):
            storage.rename(status.getPath(), as_path(f"{jsonl}/{status.getPath().getName()}.jsonl"))
    return summary(normalize(open_source(spark, f"jsonl:{jsonl}")))


@query(
    f"""{COUNTS} SELECT trace_id, count(*) AS spans, min(at_us) AS first_us, max(at_us) AS last_us FROM s WHERE at_us >= 1700100000000000 GROUP BY trace_id"""
)
def spans_since(spark, sf_dir):
    """The time filter of a scan."""
    import datetime as dt

    since = dt.datetime.fromtimestamp(1_700_100_000, dt.UTC)
    return summary(normalize(open_source(spark, t.raw_spans(spark, sf_dir), since=since)))


def otlp_value(v) -> F.Column:
    return F.struct(v.alias("stringValue"))


@query(
    f"""WITH {C} SELECT {sid(3)} AS span_id, trace_id, 'server' AS kind, at_us + 1000 AS at_us, {STATUS} AS status, text, '["a",[1,2.5],{{"b":true}}]' AS list, CAST(turn AS VARCHAR) AS turn, 'svc' AS service, 'ev' AS event FROM c WHERE role = 'user'"""
)
def otlp_documents(spark, sf_dir):
    """Documents of the protocol: numbers as text, values nested in lists and maps, kinds by number or name."""
    rows = t.table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    nested = '{"key": "list", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"arrayValue": {"values": [{"intValue": "1"}, {"doubleValue": 2.5}]}}, {"kvlistValue": {"values": [{"key": "b", "value": {"boolValue": true}}]}}]}}}'
    plain = F.to_json(F.array(attr("text", otlp_value(F.col("text"))), attr("text", otlp_value(F.col("text")))))
    turn = F.concat(F.lit('{"key": "turn", "value": {"intValue": "'), F.col("turn").cast("string"), F.lit('"}}'))
    attributes = F.concat(F.expr("left(a, length(a) - 1)"), F.lit(", "), turn, F.lit(f", {nested}]"))
    at = F.concat((1_700_000_000 + F.col("n") * 10).cast("string"), F.lit("001000999"))
    code = F.when(F.col("turn") % 6 == 3, "2").when(F.col("turn") % 6 == 1, '"STATUS_CODE_OK"').otherwise("0")
    kind = F.when(F.col("turn") % 2 == 0, "2").otherwise('"SPAN_KIND_SERVER"')
    hexed = lambda c, width: F.upper(F.lpad(F.hex(c), width, "0"))
    span = F.concat(
        F.lit('{"traceId": "'), hexed(F.col("conv_id") + 1, 32), F.lit('", "spanId": "'), hexed(F.col("n") * 10 + 3, 16),
        F.lit('", "name": "x", "kind": '), kind, F.lit(', "startTimeUnixNano": "'), at, F.lit('", "attributes": '), attributes,
        F.lit(', "events": [{"name": "ev", "timeUnixNano": "1"}], "status": {"code": '), code, F.lit("}}"),
    )
    doc = F.concat(
        F.lit(
            '{"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": ['
        ),
        F.col("span"), F.lit("]}]}]}")
    )
    path = written(rows.withColumn("a", plain).withColumn("span", span).select(doc.alias("value")), "otlp")
    spans = normalize(open_source(spark, f"otlp:{path}"))
    return spans.select(
        "span_id", "trace_id", "kind", us("start_time", "at_us"), F.col("status.code").alias("status"),
        attribute("text").alias("text"), F.regexp_replace(attribute("list"), " ", "").alias("list"),
        attribute("turn").alias("turn"), F.try_element_at("resource", F.lit("service.name")).alias("service"),
        F.col("events")[0]["name"].alias("event")
    )


EXPORTED = f"""WITH {C} SELECT sha256('span-' || n)[1:16] AS span_id, sha256('trace-' || conv_id)[1:32] AS trace_id, 'm' AS model, text AS prompt, '> ' || text AS answer, CAST(length(text) AS BIGINT) AS input_tokens, CASE WHEN turn % 6 = 3 THEN 'error' ELSE 'ok' END AS status, 0.25::DOUBLE AS temperature, 'v' || (turn % 2) AS template_version, 2000.0::DOUBLE AS latency_ms FROM c WHERE role = 'user' AND text <> ''"""


def exported(spans: DataFrame) -> DataFrame:
    from spanloom.functions.scalars import messages_text

    spans = normalize(spans)
    texts = spans.select(
        "span_id", messages_text(attribute("gen_ai.input.messages")).alias("prompt"),
        messages_text(attribute("gen_ai.output.messages")).alias("answer")
    )
    return derive(spans)["calls"].join(texts, "span_id").select(
        "span_id", "trace_id", "model", "prompt", "answer", "input_tokens", "status", "temperature", "template_version",
        "latency_ms"
    )


@query(EXPORTED)
def langfuse_observations(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations").filter("role = 'user' AND text <> ''").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    at = lambda s: F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("n") * 10 + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = F.struct(
        F.concat(F.lit("span-"), "n").alias("id"), F.concat(F.lit("trace-"), "conv_id").alias("traceId"),
        F.lit("GENERATION").alias("type"), at(0).alias("startTime"), at(2).alias("endTime"), F.lit("m").alias("model"),
        F.struct(F.lit(0.25).alias("temperature")).alias("modelParameters"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("input"),
        F.concat(F.lit("> "), F.col("text")).alias("output"), F.struct(F.length("text").alias("input")).alias("usageDetails"),
        F.concat(F.lit("v"), (F.col("turn") % 2).cast("string")).alias("promptVersion"),
        F.when(F.col("turn") % 6 == 3, "ERROR").otherwise("DEFAULT").alias("level"),
    )
    path = written(rows.select(F.to_json(o).alias("value")), "observations")
    return exported(open_source(spark, f"langfuse:{path}"))


@query(EXPORTED)
def phoenix_rows(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations").filter("role = 'user' AND text <> ''").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    at = lambda s: F.timestamp_seconds(1_700_000_000 + F.col("n") * 10 + s)
    message = lambda text: F.array(F.struct(F.lit("user").alias("message.role"), text.alias("message.content")))
    flat = rows.select(
        F.concat(F.lit("trace-"), "conv_id").alias("context.trace_id"), F.concat(F.lit("span-"), "n").alias("context.span_id"),
        F.lit("LLM").alias("span_kind"), F.lit("call").alias("name"), at(0).alias("start_time"), at(2).alias("end_time"),
        F.when(F.col("turn") % 6 == 3, "ERROR").otherwise("OK").alias("status_code"),
        F.lit("m").alias("attributes.llm.model_name"), F.length("text").alias("attributes.llm.token_count.prompt"),
        message(F.col("text")).alias("attributes.llm.input_messages"),
        F.concat(F.lit("> "), F.col("text")).alias("attributes.output.value"),
        F.lit('{"temperature": 0.25}').alias("attributes.llm.invocation_parameters"),
        F.concat(F.lit("v"), (F.col("turn") % 2).cast("string")).alias("attributes.llm.prompt_template.version"),
    )
    path = f"{fresh(spark, 'rows')}.parquet"
    flat.write.parquet(path)
    return exported(open_source(spark, f"phoenix:{path}"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS span_id, 't' || c_nationkey AS trace_id, c_mktsegment AS model, CASE WHEN c_custkey % 2 = 0 THEN 'long text ' || c_custkey ELSE 'plain' END AS note FROM customer WHERE c_nationkey < 10 AND c_custkey % 4 <> 3"
)
def sqlite_store(spark, sf_dir):
    """A span store with blobs, ``since`` applied in the file."""
    path = Path(own_dir(spark).removeprefix("file://")) / f"store-{uuid.uuid4().hex}" / "spans.db"
    rows = t.table(spark, sf_dir, "customer").filter("c_nationkey < 10").toLocalIterator()
    at = lambda k: f"2026-01-0{1 if k % 4 == 3 else 2}T00:00:00.000Z"
    note = lambda k: f"long text {k}" if k % 2 == 0 else "plain"
    write_store(
        (
            {
                "span_id": str(r.c_custkey), "trace_id": f"t{r.c_nationkey}", "name": "x", "start_time": at(r.c_custkey),
                "status": {"code": "OK"}, "attributes": {"gen_ai.request.model": r.c_mktsegment, "note": note(r.c_custkey)}
            } for r in rows
        ),
        path, large=10
    )
    import datetime as dt

    spans = normalize(open_source(spark, f"store:{path}", since=dt.datetime(2026, 1, 2, tzinfo=dt.UTC)))
    return spans.select("span_id", "trace_id", attribute("gen_ai.request.model").alias("model"), attribute("note").alias("note"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS span_id, 'n' || s_nationkey AS trace_id FROM supplier")
def own_source(spark, sf_dir):
    """An object with spans()."""
    rows = [
        {
            "trace_id": f"n{r.s_nationkey}", "span_id": str(r.s_suppkey), "name": "x", "start_time": "2026-01-01T00:00:00Z",
            "attributes": {}
        } for r in t.table(spark, sf_dir, "supplier").toLocalIterator()
    ]
    return normalize(open_source(spark, FakeSource(rows))).select("span_id", "trace_id")


@query(
    "SELECT 'run-' || n_regionkey AS run_id, 'w' AS workflow, n_name AS step, CAST(n_nationkey AS VARCHAR) AS item, CASE WHEN n_nationkey % 2 = 0 THEN 'rejected,done' ELSE 'done' END AS attempt_statuses, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CAST(n_regionkey AS BIGINT) AS run_seed, 'edit/automated' AS decisions FROM nation"
)
def flow_records(spark, sf_dir):
    """Step records of a flow runner's history."""
    history, by = FakeHistory(), {}
    for r in t.table(spark, sf_dir, "nation").toLocalIterator():
        attempts = [{"status": "rejected"}, {"status": "done"}] if r.n_nationkey % 2 == 0 else [{"status": "done"}]
        by.setdefault(r.n_regionkey, []).append(
            {
                "step": r.n_name, "item": str(r.n_nationkey), "kind": "step", "status": "done", "attempt": len(attempts),
                "attempts": attempts, "reviews": [{"decision": "edit", "actor_kind": "automated"}]
            }
        )
    for region, steps in by.items():
        history.add(f"run-{region}", steps, seed=int(region))
    from spanloom.sources.flow import FlowSource

    rows = step_records(spark, FlowSource(spark, history, "w"))
    said = F.array_join(F.transform("review_decisions", lambda d: F.concat_ws("/", d["decision"], d["actor_kind"])), ",")
    return rows.select(
        "run_id", "workflow", "step", "item", F.array_join("attempt_statuses", ",").alias("attempt_statuses"), "attempts",
        "run_seed", said.alias("decisions")
    )


@query(f"""{COUNTS}, u AS (SELECT trace_id, count(*) AS calls FROM c WHERE role = 'user' GROUP BY ALL), p AS (SELECT trace_id, count(*) AS plain FROM c WHERE turn % 7 = 1 GROUP BY ALL), n AS (SELECT trace_id, count(*) AS spans FROM s GROUP BY ALL)
SELECT n.trace_id, spans, coalesce(calls, 0) + coalesce(plain, 0) AS calls, c.steps FROM n LEFT JOIN u USING (trace_id) LEFT JOIN p USING (trace_id) JOIN (SELECT trace_id, count(*) + count(*) FILTER (WHERE turn % 3 = 0 AND turn % 2 = 1) AS steps FROM c GROUP BY ALL) c USING (trace_id)""")
def late_spans(spark, sf_dir):
    """Half of each trace's spans, then all of them again: each span is stored once, and each trace derived as a whole."""
    raw = t.raw_spans(spark, sf_dir)
    ws = Workspace(spark, fresh(spark, "workspace"))
    ws.ingest(raw.filter(F.xxhash64("span_id") % 2 == 0))
    ws.ingest(raw)
    by = lambda name, label: ws.table(name).groupBy("trace_id").agg(F.count(F.lit(1)).alias(label))
    spans = ws.spans().groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))
    out = spans.join(by("calls", "calls"), "trace_id", "left").join(by("steps", "steps"), "trace_id", "left")
    return out.select("trace_id", "spans", F.coalesce("calls", F.lit(0)).alias("calls"), "steps")


@query(
    f"""WITH {C} SELECT model, count(*) AS calls, round(avg(length(text)), 6) AS chars FROM (SELECT CASE WHEN shape = 1 THEN 'served' ELSE 'm' || (turn % 2) END AS model, text FROM c WHERE role = 'user' AND workflow = 'wf1') GROUP BY model HAVING count(*) > 1"""
)
def sql_surface(spark, sf_dir):
    """SQL on the workspace's tables by name."""
    ws = Workspace(spark, fresh(spark, "workspace"))
    ws.ingest(t.raw_spans(spark, sf_dir))
    return ws.query("""SELECT c.model, count(*) AS calls, round(avg(CASE WHEN s.attributes['gen_ai.usage.input_tokens'] = '7' THEN length(from_json(s.attributes['gen_ai.input.messages'], 'array<struct<role:string,content:string>>')[0].content) ELSE c.input_tokens END), 6) AS chars
FROM calls c JOIN spans s ON s.span_id = c.span_id WHERE c.workflow = :w AND c.model <> 'plain' GROUP BY c.model HAVING count(*) > 1""", w="wf1")
