"""Derivation: spans to calls, steps, selections, outputs and run_calls, all as DataFrame plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalars import duration_ms, finish_reason, is_model_call, messages_text
from spanloom.schemas import SECTIONS
from spanloom.scratch import materialize

#: Names of spans and attributes (those quoted below too) and final statuses, as the traces have them.
CHAT_SPAN, STEP_SPAN, GATE_SPAN, RUN_SPAN = "hone.models.chat", "hone.flow.step", "hone.flow.gate", "hone.flow.run"
WORKFLOW, RUN, STEP, ITEM, MODEL, FORK = "hone.flow.workflow", "hone.run_id", "hone.step", "hone.item", "gen_ai.request.model", "hone.flow.fork_of"
FINISHED = ("done", "failed", "ok", "error")


def attribute(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("attributes", F.lit(n)) for n in names])


def _walked(spans: DataFrame, parents: DataFrame) -> DataFrame:
    """``spans`` (trace_id, span_id, up, ...) after as many doublings as the longest chain needs.

    Each round replaces every span's pointer by its pointer's, so a chain of n takes log n rounds; a round is written, so
    plans don't grow. A pointer that is left after more rounds than any chain could take lies on a cycle.
    """
    now = materialize(spans, "walk")
    rounds, most = 0, None
    while not now.filter("up IS NOT NULL").isEmpty():
        if most is None:
            most = now.count().bit_length() + 1
        if rounds > most:
            break
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        joined = now.filter("up IS NOT NULL").join(above, ["trace_id", "up"], "left")
        moved = joined.select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        now = materialize(now.filter("up IS NULL").unionByName(moved), "walk")
        rounds += 1
    return now


def _by_hand(parents: DataFrame, left: DataFrame) -> DataFrame:
    """Depths of spans on cycles, or below them: their distinct ancestors, walked span by span inside a trace."""
    traces = left.select("trace_id").distinct()

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(pdf["span_id"], pdf["parent_span_id"], strict=True))
        out = []
        for span in up:
            seen, at = {span}, span
            while up.get(at) in up and up[at] not in seen:
                at = up[at]
                seen.add(at)
            out.append((key[0], span, len(seen) - 1))
        return pd.DataFrame(out, columns=["trace_id", "span_id", "depth"])

    found = parents.join(traces, "trace_id", "left_semi").groupBy("trace_id").applyInPandas(walk, "trace_id string, span_id string, depth int")
    return found.join(left.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")


def depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth below the trace's roots, however deep. A parent that isn't in the trace counts as none; on
    a cycle of parents (or below one) a span's depth is the number of its distinct ancestors."""
    tree = materialize(spans.select("trace_id", "span_id", "parent_span_id"), "tree")
    ids = tree.select("trace_id", F.col("span_id").alias("parent_span_id")).withColumn("_in", F.lit(True))
    first = tree.join(ids, ["trace_id", "parent_span_id"], "left")
    first = first.select("trace_id", "span_id", F.when(F.col("_in"), F.col("parent_span_id")).alias("up"), F.when(F.col("_in"), 1).otherwise(0).alias("depth"))
    done = _walked(first, tree)
    left = done.filter("up IS NOT NULL")
    fine = done.filter("up IS NULL").select("trace_id", "span_id", "depth")
    return fine if left.isEmpty() else fine.unionByName(_by_hand(tree, left))


def step_ancestors(rows: DataFrame) -> DataFrame:
    """trace_id, span_id, step_span_id: the nearest ancestor that is a step, for the spans that have one.

    Pointers stop at the first step above, so most are done after the first look; the others double as in depths(). Spans
    on a cycle of parents without a step have none.
    """
    tree = materialize(rows.select("trace_id", "span_id", "parent_span_id", "is_step"), "tree")
    above = tree.select("trace_id", F.col("span_id").alias("up"), F.col("is_step").alias("_step"), F.col("parent_span_id").alias("_up"))
    now = tree.select("trace_id", "span_id", F.col("parent_span_id").alias("up")).join(above.select("trace_id", "up", "_step"), ["trace_id", "up"], "left")
    now = now.select("trace_id", "span_id", F.when(F.col("_step").isNotNull(), F.col("up")).alias("up"), F.coalesce("_step", F.lit(False)).alias("found"))
    now = materialize(now, "walk")
    rounds, most = 0, None
    while not now.filter("up IS NOT NULL AND NOT found").isEmpty():
        most = now.count().bit_length() + 1 if most is None else most
        if rounds > most:
            break
        over = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("found").alias("_found"))
        going = now.filter("up IS NOT NULL AND NOT found").join(over, ["trace_id", "up"], "left")
        moved = going.select("trace_id", "span_id", F.col("_up").alias("up"), F.coalesce("_found", F.lit(False)).alias("found"))
        now = materialize(now.filter("up IS NULL OR found").unionByName(moved), "walk")
        rounds += 1
    return now.filter("found").select("trace_id", "span_id", F.col("up").alias("step_span_id"))


def enrich(spans: DataFrame) -> DataFrame:
    """Spans with the context that every derived table has: trace-wide values from windows, the parent from a self-join.

    The spans are dealt by trace once; the self-join and the windows use that. The result is written, as five tables read it.
    """
    dealt = spans.repartition("trace_id")
    seen = Window.partitionBy("trace_id").orderBy("start_time", "span_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(seen)
    is_step = (F.col("name") == STEP_SPAN) | ((F.col("name") == GATE_SPAN) & ~F.map_contains_key("attributes", F.lit("hone.flow.gate.decision")))
    parents = dealt.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"), F.col("name").alias("parent_name"))
    out = dealt.join(parents, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_p")), "left").drop("_t", "_p")
    out = out.withColumns({
        "workflow": F.coalesce(first(attribute(WORKFLOW)), first(F.try_element_at("resource", F.lit("service.name")))),
        "run_id": F.coalesce(attribute(RUN), "trace_id"),
        "step": F.coalesce(attribute(STEP), F.when(attribute(RUN).isNull(), F.col("parent_name"))),
        "item": attribute(ITEM),
        "fork_of": first(F.when(F.col("name") == RUN_SPAN, attribute(FORK))),
        "is_call": is_model_call(F.col("name") == CHAT_SPAN, attribute("gen_ai.operation.name"), attribute(MODEL)),
        "is_step": is_step,
        "is_run": F.col("name") == RUN_SPAN,
    })
    out = materialize(out, "enriched")
    steps = step_ancestors(out.withColumn("is_step", F.col("is_step") & ~F.col("is_call")))
    joined = out.alias("l").join(steps.alias("r"), (F.col("l.trace_id") == F.col("r.trace_id")) & (F.col("l.span_id") == F.col("r.span_id")), "left")
    return joined.select("l.*", F.coalesce("r.step_span_id", "l.parent_span_id").alias("step_span_id"))


CONTEXT = ["span_id", "trace_id", "run_id", "workflow", "step", "item", "start_time"]


def derive(spans: DataFrame) -> dict[str, DataFrame]:
    """The five derived tables. Spans of unknown kind are in none of them."""
    return tables_of(enrich(spans))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The derived tables of enriched rows: filters and projections only, no shuffle."""
    number = lambda name, kind="double": attribute(name).try_cast(kind)
    prompt, answer = messages_text(attribute("gen_ai.input.messages")), messages_text(attribute("gen_ai.output.messages"))
    retries = F.size(
        F.filter(
            F.coalesce("events", F.array().cast("array<struct<name:string,time:timestamp,attributes:map<string,string>>>")),
            lambda e: e["name"] == "retry"
        )
    )
    code = F.col("status.code")
    calls = rows.filter("is_call").select(
        *CONTEXT,
        F.coalesce(attribute("hone.models.model_id"), attribute("gen_ai.response.model"), attribute(MODEL)).alias("model"),
        attribute("gen_ai.provider.name").alias("provider"), attribute("hone.scorer").alias("scorer"),
        attribute("hone.models.prompt.template_id").alias("template_id"),
        attribute("hone.models.prompt.template_version").alias("template_version"),
        F.from_json(attribute("hone.models.prompt.sections"), SECTIONS).alias("sections"),
        attribute("hone.models.structured.path").alias("structured_path"), retries.alias("retries"),
        finish_reason(attribute("gen_ai.response.finish_reasons")).alias("finish_reason"),
        number("gen_ai.usage.input_tokens", "long").alias("input_tokens"),
        number("gen_ai.usage.output_tokens", "long").alias("output_tokens"),
        number("hone.models.context.limit", "long").alias("context_limit"),
        number("gen_ai.request.temperature").alias("temperature"), number("gen_ai.request.seed", "long").alias("seed"),
        F.when(prompt != "", F.sha2(prompt, 256)).alias("input_sha"),
        duration_ms(F.col("start_time"), F.col("end_time")).alias("latency_ms"), number("hone.models.cost_usd").alias("cost_usd"),
        number("hone.models.gpu.lease_wait_ms").alias("lease_wait_ms"),
        number("hone.models.gpu.vram_after_mb").alias("vram_after_mb"),
        unloaded(attribute("hone.models.gpu.unloaded")).alias("gpu_unloaded"), code.alias("status"),
        F.col("status.message").alias("error"), attribute("hone.models.replay_of").alias("replay_of"),
    )
    status = F.coalesce(attribute("hone.flow.status"), code)
    steps = rows.filter("NOT is_call AND is_step").select(
        *CONTEXT, attribute("hone.flow.step_version").alias("step_version"),
        attribute("hone.flow.source_hash").alias("source_hash"), status.alias("status"),
        (status.isin(*FINISHED) & attribute("hone.flow.reused_from").isNull()).cast("int").alias("executed"),
        number("hone.flow.attempt", "int").alias("attempt"), attribute("hone.flow.reused_from").alias("reused_from"), "fork_of",
        F.from_json(attribute("hone.flow.params"), "map<string,string>").alias("params"),
        number("hone.flow.seed", "long").alias("seed"),
        number("hone.flow.deterministic", "boolean").cast("int").alias("deterministic"),
        duration_ms(F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        number("system.cpu.utilization.mean").alias("cpu_utilization"),
        number("system.memory.usage.peak_mb").alias("memory_peak_mb"),
        number("hone.flow.gpu.memory.peak_mb").alias("gpu_peak_mb"),
        number("hone.flow.gpu.utilization.mean").alias("gpu_utilization"), F.col("status.message").alias("error"),
    )
    gate = F.col("name") == GATE_SPAN
    chosen = F.col("name").startswith("hone.select.") | gate
    candidate = F.get_json_object(attribute("hone.select.candidate"), "$.id")
    selections = rows.filter(~F.col("is_call") & ~F.col("is_step") & chosen).select(
        *CONTEXT, F.when(gate, "human_gate").otherwise(F.regexp_replace("name", "^hone\\.select\\.", "")).alias("kind"),
        F.coalesce(attribute("hone.candidate_id"), candidate).alias("candidate_id"),
        attribute("hone.select.scorer", "hone.scorer").alias("scorer"), number("hone.select.score.value").alias("value"),
        number("hone.select.score.confidence").alias("confidence"),
        shown_reason(attribute("hone.select.score.reason")).alias("reason"),
        F.coalesce(attribute("hone.select.score.error"), F.col("status.message")).alias("error"),
        F.coalesce(attribute("hone.select.gate", "hone.flow.gate"), F.when(gate, attribute(STEP))).alias("gate"),
        number("hone.select.gate.passed", "boolean").cast("int").alias("passed"),
        number("hone.select.gate.probability").alias("probability"), attribute("hone.flow.gate.decision").alias("decision"),
        attribute("hone.flow.gate.actor").alias("actor"), attribute("hone.flow.gate.actor_kind").alias("actor_kind"),
        attribute("hone.select.winner_id").alias("winner_id"),
        number("hone.select.fallback_used", "boolean").cast("int").alias("fallback_used"),
        number("hone.select.escalated", "boolean").cast("int").alias("escalated"),
        ranked_totals(attribute("hone.select.ranked")).alias("ranked"), code.alias("status"),
    )
    warnings = F.transform(
        F.filter("events", lambda e: e["name"] == "warning"),
        lambda e: F.struct(
            F.try_element_at(e["attributes"], F.lit("kind")).alias("kind"),
            F.try_element_at(e["attributes"], F.lit("step")).alias("step")
        )
    )
    run_calls = rows.filter(~F.col("is_call") & ~F.col("is_step") & ~chosen & F.col("is_run")).select(
        *CONTEXT, status.alias("status"), attribute(FORK).alias("fork_of"), number("hone.flow.seed", "long").alias("seed"),
        warnings.alias("warnings")
    )
    text = rows.filter("is_call").filter(attribute("hone.scorer").isNull() & attribute("hone.models.replay_of").isNull() & (answer != ""))
    outputs = text.select(
        *CONTEXT, "step_span_id", F.coalesce(attribute("gen_ai.response.model"), attribute(MODEL)).alias("model"),
        attribute("hone.models.prompt.template_version").alias("template_version"), answer.alias("text"),
        F.sha2(answer, 256).alias("text_sha")
    )
    return {"calls": calls, "steps": steps, "selections": selections, "outputs": outputs, "run_calls": run_calls}


def ranked_totals(raw: Column) -> Column:
    """[{id, total}, ...], or [[id, total], ...]; a total that is no number is null."""
    pairs = F.transform(
        F.from_json(raw, "array<array<string>>"),
        lambda p: F.struct(F.get(p, F.lit(0)).alias("id"), F.get(p, F.lit(1)).try_cast("double").alias("total"))
    )
    return F.when(raw.rlike(r"^\s*\[\s*\["), pairs).otherwise(F.from_json(raw, "array<struct<id:string,total:double>>"))


def unloaded(raw: Column) -> Column:
    """A list's length, a number, a truth value; 1 for anything else that is there."""
    listed = F.size(F.from_json(raw, "array<string>"))
    return F.when(raw.isNull(), None).when(F.startswith(raw, F.lit("[")), listed).otherwise(
        F.coalesce(raw.try_cast("int"), raw.try_cast("boolean").cast("int"), F.lit(1))
    )


def shown_reason(raw: Column) -> Column:
    """A JSON object is only measured; an empty reason is none."""
    return F.when(F.startswith(raw, F.lit("{")), F.concat(F.lit("(not captured, "), F.length(raw), F.lit(" chars)"))).otherwise(F.nullif(raw, F.lit("")))
