"""The driver's tables seen as spans and as analytic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    failed = F.col("event_type") == "error"
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("span_id"), F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("flow-"), (F.col("user_id") % 3).cast("string")).alias("workflow"), (k % 8).cast("string").alias("step"),
        F.element_at(F.array(F.lit("lab/alpha-7b"), F.lit("Beta:large"), F.lit("alpha-judge")), (k % 3 + 1).cast("int")).alias("model"),
        F.when(k % 3 == 2, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("scorer"),
        F.col("ts").cast("timestamp").alias("start_time"), F.when(failed, "error").otherwise("ok").alias("status"),
        F.col("value").alias("latency_ms"), (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("string").alias("template_version"),
        (k % 5).cast("int").alias("retries"), F.when(k % 7 == 0, "failed").when(k % 7 == 1, "native").alias("structured_path"),
        F.when(k % 11 == 0, "length").otherwise("stop").alias("finish_reason"),
        (k + 100 * F.dayofmonth("ts")).cast("long").alias("input_tokens"),
        F.when(k % 2 == 0, F.lit(2000)).cast("long").alias("context_limit"), F.sha2(k.cast("string"), 256).alias("input_sha"),
        F.when(k % 9 > 0, F.col("event_id") % 4).alias("seed"), F.when(k % 4 == 0, 1).otherwise(0).alias("gpu_unloaded"),
        F.when(k % 6 > 0, F.col("value") * 4).alias("lease_wait_ms"),
        F.when(k % 8 == 3, F.col("value") * 30).when(k % 8 < 3, F.col("value")).alias("cost_usd"),
        k.cast("double").alias("vram_after_mb"), (k % 2).cast("double").alias("temperature"),
        F.when(failed, F.when(k % 2 == 0, "HTTP 400: vision is not supported").otherwise("Out of Memory")).alias("error"),
        F.when(F.col("event_id") % 17 == 0, "x").alias("replay_of"),
        F.array(
            F.struct(F.lit("role").alias("id"), F.lit("1").alias("version"), F.lit(0).alias("start"), F.lit(4).alias("end")),
            F.struct(
                F.concat(F.lit("ex"), (k % 2).cast("string")).alias("id"), (k % 3).cast("string").alias("version"),
                F.lit(5).alias("start"), F.lit(9).alias("end")
            )
        ).alias("sections"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("span_id"),
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("workflow"),
        F.when(F.col("l_linenumber") > 5, "late").otherwise(F.concat(F.lit("L"), F.col("l_linenumber"))).alias("step"),
        (F.col("l_suppkey") % 5).cast("string").alias("item"),
        F.col("l_shipdate").cast("timestamp").alias("start_time"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("executed"),
        F.year("l_shipdate").cast("string").alias("step_version"),
        F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * 40).otherwise(F.col("l_extendedprice")).alias("duration_ms"),
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the calls' runs: a seed in every seventh run, parameters in one step."""
    k = F.col("k")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"),
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("flow-"), (F.col("user_id") % 3).cast("string")).alias("workflow"),
        (k % 8).cast("string").alias("step"),
        (k % 5).cast("string").alias("item"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.when(F.col("user_id") % 7 == 0, F.lit(5)).cast("long").alias("seed"),
        F.when(k % 8 == 2, F.create_map(F.lit("seed"), F.lit("1"))).when(k % 8 == 4, F.create_map(F.lit("size"), (k % 3).cast("string"))).alias("params"),
        (k % 4).cast("string").alias("step_version"),
    )


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("score", "score", "gate", "decision", "human_gate"))), (k % 5 + 1).cast("int"))
    value = F.when(k % 12 == 5, F.lit(None)).when(k % 3 == 0, F.lit(0.0)).when(
        k % 3 == 1, F.col("user_id") % 4 / 4 + 0.25
    ).otherwise(F.least(F.col("value") / 490, F.lit(1.0)))
    total = lambda name, t: F.struct(F.lit(name).alias("id"), t.alias("total"))
    gap = F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 == 1, F.lit(0.0078125)).otherwise(F.lit(0.25))
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("span_id"), F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("flow-"), (F.col("user_id") % 2).cast("string")).alias("workflow"), (k % 2).cast("string").alias("step"),
        (k % 7).cast("string").alias("item"), F.col("ts").cast("timestamp").alias("start_time"), kind.alias("kind"),
        F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("candidate_id"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("scorer"), value.alias("value"),
        F.when(k % 2 == 0, "too plain").when(k % 4 == 1, "Error: no answer").alias("reason"),
        F.when(k % 10 < 8, 0.5).alias("confidence"), F.when(k % 7 == 0, "").when(k % 7 == 1, "lost").alias("error"),
        F.concat(F.lit("g"), (k % 2).cast("string")).alias("gate"),
        F.when(k % 4 == 3, F.lit(None)).otherwise((k % 3 > 1).cast("int")).alias("passed"),
        F.when(
            k % 10 != 9,
            F.element_at(F.array(*map(F.lit, ("Approved", "rejected", "edit", "approve", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
        ).alias("decision"),
        F.when(k % 4 == 0, "automated").when(k % 4 == 1, "person").alias("actor_kind"),
        F.when(k % 3 == 0, F.lit(1)).when(k % 3 == 1, F.lit(0)).alias("fallback_used"),
        F.when(
            k % 2 == 1, F.array(total("a", F.lit(0.5)), total("b", 0.5 - gap), total("c", _null("double")))
        ).otherwise(F.array(total("a", F.lit(0.5)), total("b", F.lit(0.0)))).alias("ranked"),
    )


def run_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    warning = lambda kind, step: F.struct(F.lit(kind).alias("kind"), step.alias("step"))
    step = F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string"))
    warnings = F.when(
        F.col("o_orderkey") % 6 == 0, F.array(warning("source_changed_version_unchanged", step))
    ).when(F.col("o_orderkey") % 6 == 1, F.array(warning("other", step))).otherwise(F.array(
        warning("source_changed_version_unchanged", _null("string"))
    ))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("span_id"),
        F.concat(F.lit("r"), (F.col("o_custkey") * 3 + F.col("o_orderkey") % 3).cast("string")).alias("run_id"),
        F.col("o_orderpriority").alias("workflow"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        warnings.alias("warnings"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).cast("long").alias("seed"),
    )


def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step records of the calls' runs, a gate in every fourth."""
    k = F.col("k")
    review = lambda d, a: F.struct(d.alias("decision"), a.alias("actor_kind"))
    decisions = F.array(
        review(F.when(k % 3 == 0, "rejected").otherwise("approved"), F.when(k % 2 == 0, "automated")),
        review(F.when(k % 9 == 0, "edit").otherwise("approved"), F.lit("automated"))
    )
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("flow-"), (F.col("user_id") % 3).cast("string")).alias("workflow"),
        (k % 10).cast("string").alias("step"),
        F.when(k % 6 > 0, (k % 5).cast("string")).alias("item"),
        F.when(k % 4 == 0, "gate").when(k % 4 == 1, "step").alias("kind"),
        F.when(k % 5 == 0, 0).otherwise(k % 3 + 1).cast("int").alias("attempt"),
        F.when(k % 2 == 0, F.array(F.lit("rejected"), F.lit("done"))).otherwise(F.array(F.lit("done"))).alias("attempt_statuses"),
        F.when(k % 13 == 0, "r").alias("reused_from"),
        F.when(F.col("user_id") % 11 == 0, F.lit(3)).cast("long").alias("run_seed"),
        decisions.alias("review_decisions"),
        F.col("ts").cast("timestamp").alias("start_time"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("span_id"),
        F.col("lang").alias("run_id"),
        F.col("lang").alias("workflow"),
        F.col("source").alias("step"),
        F.timestamp_seconds("doc_id").alias("start_time"),
        (F.col("doc_id") % 3).cast("string").alias("template_version"),
        "text",
        F.sha2("text", 256).alias("text_sha"),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of the events' runs; steps are those of the orders only where they are asked for by name."""
    made = {"calls": calls, "steps": event_steps, "selections": selections, "run_calls": run_calls, "flow_steps": flow_steps, "outputs": outputs}
    return {name: fn(spark, sf_dir) for name, fn in made.items()}


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spans of a conversation (a trace): a run, a step for every turn, and below it a call for the user's turns, with
    messages of four shapes, old attribute names, scores, gates and decisions."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    hexed = lambda n, width: F.lpad(F.lower(F.hex(n)), width, "0")
    trace, at = hexed(F.col("conv_id") + 1, 32), F.timestamp_seconds(1_700_000_000 + F.col("n") * 10)
    span_of = lambda number: hexed(F.col("n") * 10 + number, 16)
    key = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    events_type = "array<struct<name:string,time:timestamp,attributes:map<string,string>>>"

    def span(number, name, parent, attributes, *, status=None, message=None, events=None, seconds=2):
        pairs = F.filter(F.array(*[key(k, v) for k, v in attributes.items()]), lambda p: p["value"].isNotNull())
        code = F.lit("ok") if status is None else status
        return F.struct(
            trace.alias("trace_id"), span_of(number).alias("span_id"), parent.cast("string").alias("parent_span_id"),
            F.lit(name).alias("name"), F.lit("internal").alias("kind"), at.alias("start_time"),
            F.timestamp_seconds(1_700_000_000 + F.col("n") * 10 + seconds).alias("end_time"),
            F.struct(code.alias("code"), (F.lit(None) if message is None else message).cast("string").alias("message")).alias("status"),
            F.map_from_entries(pairs).alias("attributes"),
            (F.array() if events is None else events).cast(events_type).alias("events"),
            F.create_map(F.lit("service.name"), F.lit("svc")).alias("resource"),
            F.array().cast("array<struct<trace_id:string,span_id:string>>").alias("links"),
        )

    turn = F.col("turn")
    own = {
        "hone.run_id": F.concat(F.lit("run-"), F.col("conv_id").cast("string")),
        "hone.step": F.concat(F.lit("t"), (turn % 3).cast("string")), "hone.item": turn
    }
    flow = {"hone.flow.workflow": F.when(F.col("conv_id") % 4 > 0, F.concat(F.lit("wf"), (F.col("conv_id") % 4).cast("string")))}
    listed = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    pieces = F.to_json(
        F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    )
    event = F.array(F.struct(F.lit("gen_ai.user.message").alias("name"), at.alias("time"), F.create_map(F.lit("content"), F.col("text")).alias("attributes")))
    retried = F.array(F.struct(F.lit("retry").alias("name"), at.alias("time"), F.create_map().cast("map<string,string>").alias("attributes")))
    shape = F.col("n") % 4
    call = {
        "gen_ai.operation.name": F.when(shape < 2, "chat"),
        "gen_ai.request.model": F.concat(F.lit("m"), (turn % 2).cast("string")),
        "gen_ai.response.model": F.when(shape == 1, "served"), "gen_ai.system": F.lit("prov"),
        "gen_ai.usage.prompt_tokens": F.length("text"), "gen_ai.usage.input_tokens": F.when(shape == 2, F.lit(7)),
        "gen_ai.input.messages": F.when(shape == 0, listed).when(shape == 1, pieces),
        "gen_ai.prompt.0.role": F.when(shape == 2, "user"), "gen_ai.prompt.0.content": F.when(shape == 2, F.col("text")),
        "gen_ai.output.messages": F.when(
            turn % 3 > 0,
            F.to_json(F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("> "), F.col("text")).alias("content"))))
        ),
        "gen_ai.response.finish_reasons": F.when(shape == 0, '["length","x"]').when(shape == 1, "stop"),
        "gen_ai.request.temperature": F.lit(0.5), "gen_ai.request.seed": F.when(shape == 3, F.col("n")),
        "hone.models.gpu.unloaded": F.when(shape == 0, '["a","b"]').when(shape == 1, "true").when(shape == 2, "3"),
        "hone.models.prompt.template_version": turn % 2 + 1, "hone.scorer": F.when(turn % 5 == 4, "judge"),
        "hone.models.prompt.sections": F.concat(
            F.lit('[{"id": "head", "version": "'), (turn % 2).cast("string"),
            F.lit('", "start": 2, "end": 9}, {"id": "odd", "version": "1"}]')
        ),
    }
    step = {
        "hone.flow.status": F.when(turn % 4 == 0, "failed").when(turn % 4 == 1, "skipped"), "hone.flow.step_version": F.lit("2"),
        "hone.flow.reused_from": F.when(turn % 4 == 2, "old"), "hone.flow.params": F.when(turn % 2 == 0, '{"size": "3"}')
    }
    score = {
        "hone.select.scorer": F.lit("s"), "hone.select.score.value": (turn % 5) / 4,
        "hone.select.score.reason": F.when(turn % 3 == 0, '{"a": 1}').when(turn % 3 == 1, "fine").otherwise(""),
        "hone.select.candidate": F.when(turn % 2 == 0, '{"id": "c0"}'), "hone.candidate_id": F.when(turn % 2 == 1, "c1")
    }
    gate = {"hone.flow.gate.decision": F.when(turn % 2 == 0, "rejected"), "hone.flow.gate.actor_kind": F.when(turn % 4 == 0, "automated")}
    decision = {
        "hone.select.ranked": F.when(turn % 2 == 0, '[["a", 0.5], ["b", 0.25]]').otherwise('[{"id": "a", "total": 0.5}]'),
        "hone.select.fallback_used": F.when(turn % 2 == 0, "true").otherwise("false"), "hone.select.winner_id": F.lit("a")
    }
    run_id = {"hone.flow.fork_of": F.when(F.col("conv_id") % 3 == 0, "f"), "hone.flow.seed": F.when(F.col("conv_id") % 2 == 0, F.lit(9))}
    warned = F.array(
        F.struct(
            F.lit("warning").alias("name"), at.alias("time"),
            F.create_map(F.lit("kind"), F.lit("k"), F.lit("step"), F.lit("t0")).alias("attributes")
        )
    )
    first, user = turn == 0, F.col("role") == "user"
    bad = F.when(turn % 6 == 3, F.lit("STATUS_CODE_ERROR")).when(turn % 6 == 1, F.lit("1")).otherwise(F.lit("unknown"))
    rows = [
        F.when(first, span(0, "hone.flow.run", F.lit(None), own | flow | run_id, events=warned)),
        span(1, "hone.flow.step", F.when(first, span_of(0)), own | step),
        F.when(user, span(2, "wrapper", span_of(1), {"note": F.lit("x")})),
        F.when(
            user,
            span(
                3, "hone.models.chat", span_of(2), own | call, status=bad, message=F.when(turn % 6 == 3, "boom"),
                events=F.when(shape == 3, event).otherwise(retried), seconds=3
            )
        ),
        F.when(turn % 2 == 1, span(4, "hone.select.score", span_of(1), own | score)),
        F.when(turn % 3 == 0, span(5, "hone.flow.gate", span_of(1), own | gate)),
        F.when(turn % 5 == 0, span(6, "hone.select.decision", span_of(1), own | decision)),
        F.when(turn % 7 == 1, span(7, "child", span_of(2), {"gen_ai.request.model": F.lit("plain")})),
    ]
    return c.select(F.explode(F.array_compact(F.array(*rows))).alias("s")).select("s.*")
