"""The nine detectors: functions from analytic tables (by name) to the findings' rows and the rows behind them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import SpanloomError
from spanloom.functions import stats
from spanloom.operators.rates import Found, Rate, rates, severity

#: Words of statuses and decisions, and patterns of error texts.
REPAIRED = ("retried", "repaired", "failed")
FAILED = ("failed", "error")
APPROVALS = ("approve", "approved")
OVERRIDES = ("reject", "rejected", "edit", "edited", "overrule", "overruled")
AUTOMATED = "automated"
STALE_SOURCE = "source_changed_version_unchanged"
CAPABILITY = r"(?i)\b400\b|not support|unsupported|capabilit"
ERROR_LIKE = r"(?i)^\W*(error|exception|failed|could not|couldn't|unable to)\b|traceback|timed out|invalid json|(parse|parsing) (error|failed)"

Tables = Mapping[str, DataFrame]
Detector = Callable[[Tables], list[Found]]


@dataclass(frozen=True)
class Registered:
    category: str
    run: Callable
    custom: bool = False


REGISTRY: dict[str, Registered] = {}


def detector(category: str = "quality", name: str | None = None) -> Callable:
    """Register a detector of one's own; analyze() runs it after the built-in ones, on the scoped tables.

    It may return Found, a list of them, a DataFrame of finding rows, or a list of findings.
    """

    def put(fn: Callable) -> Callable:
        key = name or fn.__name__
        if key in REGISTRY:
            raise SpanloomError(f"a detector {key!r} is registered already; give it another name")
        REGISTRY[key] = Registered(category, fn, custom=True)
        return fn

    return put


def _built_in(category: str) -> Callable[[Detector], Detector]:
    def put(fn: Detector) -> Detector:
        REGISTRY[fn.__name__] = Registered(category, fn)
        return fn

    return put


def own_calls(t: Tables) -> DataFrame:
    return t["calls"].filter("replay_of IS NULL")


def _on(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _is(column: str) -> Column:
    """0 and null are both no."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) != 0


def first_last() -> tuple[Column, Column]:
    return F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen")


@_built_in("reliability")
def failure_rate(t: Tables) -> list[Found]:
    """Errors, retries and repaired outputs of calls, and failed steps."""
    return [call_failures(t), step_failures(t)]


def call_failures(t: Tables) -> Found:
    calls = own_calls(t).withColumn("prompt_version", F.col("template_version"))
    metrics = [
        Rate("error_rate", F.col("status") == "error"),
        Rate("retry_rate", _is("retries")),
        Rate("repair_rate", F.col("structured_path").isin(*REPAIRED)),
    ]
    return rates(calls, ["workflow", "step", "model", "scorer", "prompt_version"], metrics)


def step_failures(t: Tables) -> Found:
    """Steps that were skipped, blocked or reused are neither failures nor successes."""
    return rates(t["steps"].filter("executed = 1"), ["workflow", "step"], [Rate("step_error_rate", F.col("status").isin(*FAILED))])


@_built_in("reliability")
def truncation(t: Tables) -> list[Found]:
    """Calls that ended by length, how many of them had prompts near the context limit, and how many were repaired."""
    cut = F.col("finish_reason") == "length"
    near = cut & _is("context_limit") & (F.coalesce("input_tokens", F.lit(0)) >= 0.9 * F.col("context_limit"))
    repaired = cut & F.col("structured_path").isin(*REPAIRED)
    rate = Rate("truncation_rate", cut, high=0.05, medium=0.01)
    return [rates(own_calls(t), ["workflow", "step", "model"], [rate], near_context_limit=F.count_if(near), repaired=F.count_if(repaired))]


@_built_in("cost")
def cost_latency(t: Tables) -> list[Found]:
    """Steps that take most of a workflow's time or cost, and prompts that grew."""
    executed = t["steps"].filter("executed = 1")
    return [top_share(executed, "duration_ms", "time_share"), top_share(own_calls(t), "cost_usd", "cost_share"), token_growth(t)]


def top_share(rows: DataFrame, column: str, metric: str) -> Found:
    """The step with the largest sum (of equal ones, the first seen), where it is most of its workflow's; zeros don't count."""
    counts = F.coalesce(column, F.lit(0.0)) != 0
    mine = F.when(counts, F.col("start_time"))
    by_step = rows.groupBy("workflow", "step").agg(
        F.sum(F.when(counts, F.col(column))).alias("amount"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(counts).alias("hits"),
        F.min(F.when(counts, F.struct("start_time", "span_id"))).alias("seen"),
        F.min(mine).alias("first_seen"),
        F.max(mine).alias("last_seen"),
    )
    w = Window.partitionBy("workflow")
    steps = F.count("amount").over(w)
    share = F.col("amount") / F.sum("amount").over(w)
    ranked = by_step.withColumns(
        {"steps": steps, "value": share, "total": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.col("amount").desc_nulls_last(), "seen"))}
    )
    top = ranked.filter((F.col("k") == 1) & (F.col("steps") >= 2) & (F.col("value") >= F.greatest(F.lit(0.5), F.lit(1.5) / F.col("steps"))))
    found = top.select(
        "workflow", "step", F.lit(metric).alias("metric"), "hits", "total", "value", F.lit("low").alias("severity"), F.lit("cost").alias("category"),
        "first_seen", "last_seen", (1 / F.col("steps")).alias("baseline"), "steps",
    )
    hits = rows.filter(counts).select("workflow", "step", F.lit(metric).alias("metric"), "span_id", "run_id", "start_time")
    return Found(found, hits, ("workflow", "step"))


def token_growth(t: Tables, *, least: float = 0.5) -> Found:
    """Medians of input tokens that grew between versions that follow each other by first appearance."""
    keys, label = ["workflow", "step", "scorer"], "prompt_version"
    versioned = own_calls(t).filter("template_version IS NOT NULL AND input_tokens IS NOT NULL").withColumn(label, F.col("template_version"))
    seen = versioned.groupBy(*keys, label).agg(F.min(F.struct("start_time", "span_id")).alias("seen"), F.count(F.lit(1)).alias("hits"), *first_last())
    by = seen.alias("l").join(
        stats.medians(versioned, [*keys, label], "input_tokens", "value").alias("r"), _on("l", "r", [*keys, label])
    ).select("l.*", "r.value")
    w = Window.partitionBy(*keys)
    by = by.withColumns({"before": F.lag(label).over(w.orderBy("seen")), "baseline": F.lag("value").over(w.orderBy("seen")), "total": F.sum("hits").over(w)})
    growth = F.col("value") / F.col("baseline") - 1
    found = by.filter((F.col("baseline") > 0) & (growth >= least)).select(
        *keys, label, F.lit("median_input_tokens").alias("metric"), "hits", "total", "value",
        F.when(growth >= 1.0, "medium").otherwise("low").alias("severity"), F.lit("cost").alias("category"), "first_seen",
        "last_seen", "baseline", growth.alias("growth"), F.lit(label).alias("field"), "before", F.col(label).alias("after"),
    )
    hits = versioned.select(*keys, label, F.lit("median_input_tokens").alias("metric"), "span_id", "run_id", "start_time")
    return Found(found, hits, (*keys, label))


@_built_in("cost")
def gpu_thrash(t: Tables, *, slow_ms: float = 1000.0) -> list[Found]:
    """Model swaps a run, slow leases and calls out of memory, by workflow."""
    calls = own_calls(t).withColumns({"_oom": F.coalesce(F.lower("error").contains("out of memory"), F.lit(False)), "_swap": _is("gpu_unloaded")})
    hit = F.col("_swap") | F.col("_oom") | (F.coalesce("lease_wait_ms", F.lit(0.0)) >= slow_ms)
    mine = F.when(hit, F.col("start_time"))
    out = calls.groupBy("workflow").agg(
        F.count_if("_swap").alias("swaps"),
        F.countDistinct("run_id").alias("runs"),
        F.count_if("_oom").alias("oom_errors"),
        F.max("vram_after_mb").alias("vram_peak_mb"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("hits"),
        F.min(mine).alias("first_seen"),
        F.max(mine).alias("last_seen"),
    )
    waits = stats.medians(calls, ["workflow"], "lease_wait_ms", "wait")
    out = out.alias("l").join(waits.alias("r"), _on("l", "r", ["workflow"]), "left").select(
        "l.*", F.coalesce("r.wait", F.lit(0.0)).alias("median_lease_wait_ms")
    )
    value = F.col("swaps") / F.col("runs")
    fires = (value >= 0.5) | (F.col("median_lease_wait_ms") >= slow_ms) | (F.col("oom_errors") > 0)
    high = (F.col("oom_errors") > 0) | (value >= 1)
    found = out.filter(fires).select(
        "workflow", F.lit("model_swaps_per_run").alias("metric"), "hits", "total", value.alias("value"),
        F.when(high, "high").otherwise("medium").alias("severity"), F.lit("cost").alias("category"), "first_seen", "last_seen",
        F.lit(0.0).alias("baseline"), "swaps", "runs", "oom_errors", "median_lease_wait_ms", "vram_peak_mb",
    )
    hits = calls.filter(hit).select("workflow", F.lit("model_swaps_per_run").alias("metric"), "span_id", "run_id", "start_time")
    return [Found(found, hits, ("workflow",))]


@_built_in("reliability")
def reuse_health(t: Tables) -> list[Found]:
    """For each step: runs with a stale-source warning among the resumed runs (more than one call, or such a warning)."""
    listed = F.coalesce("warnings", F.array().cast("array<struct<kind:string,step:string>>"))
    stale = F.transform(F.filter(listed, lambda w: (w["kind"] == STALE_SOURCE) & (F.coalesce(w["step"], F.lit("")) != "")), lambda w: w["step"])
    calls = t["run_calls"].withColumn("_w", stale)
    by_run = calls.groupBy("workflow", "run_id").agg((F.count(F.lit(1)) + F.max(F.size("_w")) > 1).alias("resumed"))
    total = by_run.groupBy("workflow").agg(F.count_if("resumed").alias("total"))
    warned = calls.select("workflow", "run_id", F.explode("_w").alias("step"), F.struct("start_time", "span_id").alias("_c"))
    first = warned.groupBy("workflow", "step", "run_id").agg(F.min("_c").alias("_c")).select("workflow", "step", "run_id", "_c.*")
    hits = first.select("workflow", "step", F.lit("stale_source_rate").alias("metric"), "span_id", "run_id", "start_time")
    by_step = first.groupBy("workflow", "step").agg(F.count(F.lit(1)).alias("hits"), *first_last())
    value = F.col("hits") / F.col("total")
    found = by_step.alias("l").join(total.alias("r"), _on("l", "r", ["workflow"])).select("l.*", "r.total").select(
        "workflow", "step", F.lit("stale_source_rate").alias("metric"), "hits", "total", value.alias("value"), severity(value, 0.05, 0.01).alias("severity"),
        F.lit("reliability").alias("category"), "first_seen", "last_seen", F.lit(0.0).alias("baseline"),
    )
    return [Found(found, hits, ("workflow", "step"))]


def scores(t: Tables) -> DataFrame:
    return t["selections"].filter("kind = 'score'")


def next_level(t: Tables) -> DataFrame:
    """For each workflow and scorer: scores, zeros, the scores at the level next to zero, and whether the zeros spike.

    Few distinct positive values (1 to 10, and twice as many scores as levels with zero): the least of them is the
    level. Otherwise the level is the range from 0 to 0.2.
    """
    keys = ["workflow", "scorer"]
    by_value = scores(t).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    up = F.when(F.col("value") > 0, F.col("value"))
    counted = by_value.withColumns(
        {
            "_levels": F.count(up).over(w),
            "_least": F.min(up).over(w),
            "_scored": F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(w),
        }
    )
    discrete = F.col("_levels").between(1, 10) & (F.col("_scored") >= 2 * (F.col("_levels") + 1))
    near = F.when(discrete, F.col("value") == F.col("_least")).otherwise((F.col("value") > 0) & (F.col("value") < 0.2))
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = counted.groupBy(*keys).agg(F.sum("n").alias("total"), sum_if(F.col("value") == 0).alias("zeros"), sum_if(near).alias("next_level"))
    return out.withColumn("spike", (F.col("zeros") > 0) & (F.col("next_level") < F.col("zeros") / 2))


def answered() -> Column:
    """A zero that the judge gave: a reason that is no error text, a confidence, and no error."""
    said = F.coalesce("reason", F.lit(""))
    return (said != "") & F.col("confidence").isNotNull() & (F.coalesce("error", F.lit("")) == "") & ~said.rlike(ERROR_LIKE)


@_built_in("quality")
def selection_health(t: Tables) -> list[Found]:
    return [missing_scores(t), zero_scores(t), gate_rejections(t), decisions(t), judge_disagreement(t)]


def missing_scores(t: Tables) -> Found:
    return rates(scores(t), ["workflow", "scorer"], [Rate("none_score_rate", F.col("value").isNull(), 0.05, 0.5, 0.05)])


def zero_scores(t: Tables) -> Found:
    """Zeros that spike: those a judge explained are floor scores, the others look like failures recorded as 0.

    Shares are of all scores of the group. Details: the first three reasons, and the judge's calls whose answer failed to
    parse.
    """
    keys = ["workflow", "scorer"]
    zero = F.col("value") == 0
    spikes = next_level(t).filter("spike")
    rows = scores(t).alias("s")
    rows = rows.join(spikes.alias("k"), _on("s", "k", keys), "left_semi")
    metrics = [
        Rate("zero_score_rate", zero & ~answered(), 0.05, 0.1, 0.05, "quality"),
        Rate("floor_score_rate", zero & answered(), 0.05, 0.3, 0.1, "quality"),
    ]
    found = rates(rows, keys, metrics)
    order = Window.partitionBy(*keys).orderBy("start_time", "span_id")
    said = rows.filter(zero & answered()).withColumn("_k", F.row_number().over(order)).filter("_k <= 3")
    reasons = said.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", F.substring("reason", 1, 200).alias("r")))), lambda x: x["r"]).alias("reasons")
    )
    failed = t["calls"].filter("structured_path = 'failed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("failed"))
    out = found.rows.alias("l").join(reasons.alias("r"), _on("l", "r", keys), "left").join(failed.alias("f"), _on("l", "f", keys), "left")
    floor = F.col("l.metric") == "floor_score_rate"
    detailed = out.select(
        "l.*", F.when(floor, F.col("r.reasons")).alias("sample_reasons"),
        F.when(~floor, F.coalesce("f.failed", F.lit(0))).alias("failed_judge_calls")
    )
    return Found(detailed, found.hits, found.keys)


def gate_rejections(t: Tables) -> Found:
    gates = t["selections"].filter("kind = 'gate'")
    return rates(gates, ["workflow", "gate"], [Rate("gate_rejection_rate", F.col("passed") == 0, 0.5, 0.5, 0.5, "quality")])


def margin() -> Column:
    """The winner's total less the runner-up's; null for fewer than two totals."""
    totals = F.array_sort(F.transform(F.filter("ranked", lambda r: r["total"].isNotNull()), lambda r: -r["total"]))
    return F.when(F.size(totals) >= 2, F.get(totals, F.lit(1)) - F.get(totals, F.lit(0)))


def decisions(t: Tables) -> Found:
    """Fallbacks, and decisions whose two best totals are closer than 0.02 (an exact tie doesn't count)."""
    thin = (F.col("_margin") != 0) & (F.col("_margin") < 0.02)
    rows = t["selections"].filter("kind = 'decision'").withColumn("_margin", margin())
    metrics = [Rate("fallback_rate", _is("fallback_used"), 0.1, 0.5, 0.1, "quality"), Rate("low_margin_rate", thin, 0.3, 0.5, 0.3, "quality")]
    return rates(rows, ["workflow"], metrics)


def judge_disagreement(t: Tables) -> Found:
    """Candidates with several scorers whose scores lie more than 0.5 apart; a candidate counts as its first score."""
    scored = scores(t).filter((F.coalesce("candidate_id", F.lit("")) != "") & F.col("value").isNotNull())
    by = scored.groupBy("workflow", "candidate_id").agg(
        F.count_distinct(F.coalesce("scorer", F.lit(""))).alias("scorers"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.min(F.struct("start_time", "span_id", "run_id")).alias("_first"),
    )
    several = by.filter("scorers > 1").select("workflow", "spread", "_first.*")
    return rates(several, ["workflow"], [Rate("judge_disagreement_rate", F.col("spread") > 0.5, 0.2, 0.5, 0.2, "quality")])


def reviews(t: Tables) -> DataFrame:
    """Decided gates; one without a decision is a pause."""
    return t["selections"].filter("kind = 'human_gate' AND decision IS NOT NULL")


@_built_in("quality")
def human_override(t: Tables) -> list[Found]:
    found = [overrides(t), automated_rework(t)]
    return [*found, revisions(t)] if "flow_steps" in t else found


def overrides(t: Tables) -> Found:
    """Gates of five decisions and more by people (an unknown actor is one)."""
    people = reviews(t).filter(~F.col("actor_kind").eqNullSafe(AUTOMATED))
    found = rates(people, ["workflow", "step", "gate"], [Rate("override_rate", F.lower("decision").isin(*OVERRIDES), 0.2, 0.4, 0.2, "quality")])
    return Found(found.rows.filter("total >= 5"), found.hits, found.keys)


def automated_rework(t: Tables) -> Found:
    """Items that a script let pass only after it had sent them back, among the items that it let pass."""
    keys = ["workflow", "step", "gate"]
    back, passed = F.lower("decision").isin(*OVERRIDES), F.lower("decision").isin(*APPROVALS)
    items = reviews(t).filter(F.col("actor_kind") == AUTOMATED).groupBy(*keys, "run_id", "item").agg(
        F.count_if(back).alias("rounds"), F.max(F.when(passed, F.struct("start_time", "span_id"))).alias("_last")
    )
    items = items.filter("_last IS NOT NULL").select(*keys, "run_id", "rounds", "_last.*")
    found = rates(
        items, keys, [Rate("automated_rework_rate", F.col("rounds") > 0, 0.2, 1.1, 0.5, "quality")],
        mean_rounds=F.bround(F.avg("rounds"), 2), max_rounds=F.max("rounds")
    )
    counts = items.groupBy(*keys, "rounds").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("rounds").cast("string"), "n")))).alias("rounds_until_approved")
    )
    rows = found.rows.alias("l").join(histogram.alias("r"), _on("l", "r", keys), "left").select("l.*", "r.rounds_until_approved")
    return Found(rows, found.hits, found.keys)


def sent_back_by_scripts(flow_steps: DataFrame) -> DataFrame:
    """run_id, item: those whose gate rejections all came from automated reviewers."""
    rejections = F.filter("review_decisions", lambda d: F.lower(d["decision"]).isin(*OVERRIDES))
    kinds = F.transform(rejections, lambda d: F.coalesce(d["actor_kind"] == AUTOMATED, F.lit(False)))
    each = flow_steps.filter("kind = 'gate'").select("run_id", "item", F.explode(kinds).alias("_auto"))
    return each.groupBy("run_id", "item").agg(F.bool_and("_auto").alias("_all")).filter("_all").select("run_id", "item")


def revision_rows(t: Tables) -> DataFrame:
    """Executed step records with ``rejected`` (attempts that people sent back) and the step's latest span as evidence."""
    ran = t["flow_steps"].filter("NOT (kind <=> 'gate') AND reused_from IS NULL AND attempt >= 1")
    latest = t["steps"].groupBy("run_id", "step", "item").agg(F.max_by("span_id", F.struct("start_time", "span_id")).alias("latest"))
    scripts = sent_back_by_scripts(t["flow_steps"]).withColumn("_script", F.lit(True))
    rejected = F.size(F.filter(F.coalesce("f.attempt_statuses", F.array().cast("array<string>")), lambda s: s == "rejected"))
    named = F.concat_ws("/", "f.run_id", "f.step", F.coalesce("f.item", F.lit("")))
    joined = ran.alias("f").join(
        latest.alias("s"), _on("f", "s", ["run_id", "step", "item"]), "left"
    ).join(scripts.alias("a"), _on("f", "a", ["run_id", "item"]), "left")
    return joined.select(
        "f.workflow", "f.step", "f.run_id", "f.start_time", F.coalesce("s.latest", named).alias("span_id"),
        F.when(F.col("a._script"), 0).otherwise(rejected).alias("rejected")
    )


def revisions(t: Tables) -> Found:
    """Items that a reviewer rejected, so that their step ran again."""
    rate = Rate("revision_rate", F.col("rejected") > 0, 0.2, 0.4, 0.2, "quality")
    return rates(revision_rows(t), ["workflow", "step"], [rate], revisions=F.sum("rejected"), max_revisions=F.max("rejected"))


def family(model: Column) -> Column:
    """The model's family: after the last slash, lower case, up to the first hyphen or colon."""
    return F.regexp_extract(F.lower(F.element_at(F.split(model, "/"), -1)), r"^([^-:]*)", 1)


@_built_in("setup")
def setup_smells(t: Tables) -> list[Found]:
    return [same_family_judge(t), capability_errors(t), unseeded_repeats(t)]


def same_family_judge(t: Tables) -> Found:
    """Judges from a family that generates in the same workflow."""
    keys = ["workflow", "scorer", "model"]
    mine = own_calls(t).filter("model <> ''").withColumn("family", family(F.col("model")))
    judged = F.coalesce("scorer", F.lit("")) != ""
    makers = mine.filter(~judged).select("workflow", "family").distinct()
    judges = mine.filter(judged).groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("total"), *first_last())
    hit = judges.alias("l").join(makers.alias("r"), _on("l", "r", ["workflow", "family"]), "left_semi")
    found = hit.select(
        *keys, F.lit("same_family_judge_share").alias("metric"), F.col("total").alias("hits"), "total", F.lit(1.0).alias("value"),
        F.lit("medium").alias("severity"), F.lit("setup").alias("category"), "first_seen", "last_seen",
        F.lit(0.0).alias("baseline"),
    )
    hits = mine.filter(judged).select(*keys, F.lit("same_family_judge_share").alias("metric"), "span_id", "run_id", "start_time")
    return Found(found, hits, tuple(keys))


def capability_errors(t: Tables) -> Found:
    hit = (F.col("status") == "error") & F.coalesce(F.col("error").rlike(CAPABILITY), F.lit(False))
    first = F.min(F.when(hit, F.struct("start_time", "span_id", "error")))["error"]
    return rates(own_calls(t), ["workflow", "scorer", "model"], [Rate("capability_error_rate", hit, 0.0, 0.0, 0.0, "setup")], first_error=first)


def seeded_runs(t: Tables) -> DataFrame:
    """run_id of the runs that record a seed, on a run's span, a step's span or in the run's records."""
    parts = [
        t[n].filter(F.col(c).isNotNull()).select("run_id") for n,
        c in (("run_calls", "seed"), ("steps", "seed"), ("flow_steps", "run_seed")) if n in t and c in t[n].columns
    ]
    out = parts[0] if parts else t["calls"].select("run_id").limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def unseeded_repeats(t: Tables) -> Found:
    """Calls whose prompt came back under another seed, where neither the run has a seed nor the step a seed parameter.

    Calls without a seed or a prompt are no repeats, but count in the total, as those of seeded runs do.
    """
    keys = ["workflow", "step", "model"]
    rows = own_calls(t).join(seeded_runs(t).withColumn("_seeded", F.lit(True)), "run_id", "left")
    if "steps" in t and "params" in t["steps"].columns:
        here = t["steps"].filter(F.map_contains_key("params", F.lit("seed"))).select("workflow", "step").distinct().withColumn("_param", F.lit(True))
        rows = rows.alias("l").join(here.alias("r"), _on("l", "r", ["workflow", "step"]), "left").select("l.*", "r._param")
    else:
        rows = rows.withColumn("_param", F.lit(None).cast("boolean"))
    can = (F.coalesce("input_sha", F.lit("")) != "") & F.col("seed").isNotNull() & F.col("_seeded").isNull() & F.col("_param").isNull()
    rows = rows.withColumn("_sha", F.when(can, F.col("input_sha")))
    by_sha = rows.groupBy(*keys, "_sha").agg(
        ((F.max("seed") > F.min("seed")) & F.col("_sha").isNotNull()).alias("_varied"), F.count(F.lit(1)).alias("n"), *first_last()
    )
    varied = lambda c: F.when(F.col("_varied"), F.col(c))
    out = by_sha.groupBy(*keys).agg(
        F.coalesce(F.sum(varied("n")), F.lit(0)).alias("hits"), F.sum("n").alias("total"),
        F.min(varied("first_seen")).alias("first_seen"), F.max(varied("last_seen")).alias("last_seen"),
    )
    found = out.filter("hits >= 3").select(
        *keys, F.lit("unseeded_repeat_rate").alias("metric"), "hits", "total", (F.col("hits") / F.col("total")).alias("value"), F.lit("low").alias("severity"),
        F.lit("setup").alias("category"), "first_seen", "last_seen", F.lit(0.0).alias("baseline"),
    )
    shas = by_sha.filter("_varied").select(*keys, "_sha")
    hits = rows.alias("l").join(shas.alias("r"), _on("l", "r", keys) & (F.col("l._sha") == F.col("r._sha")), "left_semi")
    return Found(found, hits.select(*keys, F.lit("unseeded_repeat_rate").alias("metric"), "span_id", "run_id", "start_time"), tuple(keys))


def boundaries(rows: DataFrame, keys: list[str], version: str, *, least: int = 0) -> DataFrame:
    """keys, before, after: versions that follow each other by first appearance, both with ``least`` rows or more. A version
    that returns is one version."""
    seen = rows.filter(F.col(version).isNotNull()).groupBy(*keys, version).agg(
        F.min(F.struct("start_time", "span_id")).alias("seen"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(*keys).orderBy("seen")
    out = seen.withColumns({"before": F.lag(version).over(w), "n_before": F.lag("n").over(w)}).filter("before IS NOT NULL")
    return out.filter((F.col("n") >= least) & (F.col("n_before") >= least)).select(*keys, "before", F.col(version).alias("after"))


def sides(rows: DataFrame, keys: list[str], version: str, edges: DataFrame | None = None) -> DataFrame:
    """Each row once for each boundary (all, or those of ``edges``) that its version is part of: side 'a' before, 'b' after."""
    a, b = (F.struct(F.lit(s).alias("side"), F.col(c).alias("_v")) for s, c in (("a", "before"), ("b", "after")))
    edges = boundaries(rows, keys, version) if edges is None else edges
    both = edges.select(*keys, "before", "after", F.explode(F.array(a, b)).alias("_s")).select(*keys, "before", "after", "_s.*")
    return rows.alias("l").join(both.alias("r"), _on("l", "r", keys) & (F.col(f"l.{version}") == F.col("r._v"))).select("l.*", "r.before", "r.after", "r.side")


def latency_changes(
    rows: DataFrame, *, keys: list[str], version: str, value: str = "latency_ms", least: int = 20, ratio: float = 1.2,
    edges: DataFrame | None = None
) -> DataFrame:
    """Every boundary with medians before and after, the Mann-Whitney z, and whether the median regressed."""
    group = [*keys, "before", "after"]
    dealt = sides(rows, keys, version, edges)
    counts = dealt.groupBy(*group).agg(F.count_if(F.col("side") == "a").alias("rows_a"), F.count_if(F.col("side") == "b").alias("rows_b"))
    test = stats.mann_whitney(dealt, group, "side", value)
    by_side = stats.medians(dealt, [*group, "side"], value).groupBy(*group).agg(
        F.max(F.when(F.col("side") == "a", F.col("median"))).alias("baseline"), F.max(F.when(F.col("side") == "b", F.col("median"))).alias("value")
    )
    out = counts.alias("c").join(test.alias("t"), _on("c", "t", group)).join(by_side.alias("m"), _on("c", "m", group))
    out = out.select("c.*", "t.n_a", "t.n_b", "t.u", "t.z", "m.baseline", "m.value")
    grew = (F.col("baseline") != 0) & (F.col("value") / F.col("baseline") >= ratio)
    regressed = (F.col("rows_a") >= least) & (F.col("rows_b") >= least) & grew & (F.abs("z") > stats.Z_01)
    high = F.col("value") / F.col("baseline") >= 1.5
    return out.withColumns({"regressed": F.coalesce(regressed, F.lit(False)), "severity": F.when(high, "high").otherwise("medium")})


def error_changes(rows: DataFrame, *, keys: list[str], version: str, least: int = 20, rise: float = 0.02, edges: DataFrame | None = None) -> DataFrame:
    group = [*keys, "before", "after"]
    a, b, bad = F.col("side") == "a", F.col("side") == "b", F.col("status").isin(*FAILED)
    out = sides(rows, keys, version, edges).groupBy(*group).agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & bad).alias("hits_a"), F.count_if(b & bad).alias("hits_b")
    )
    z = stats.two_proportion_z(F.col("hits_b"), F.col("n_b"), F.col("hits_a"), F.col("n_a"))
    out = out.withColumns({"z": z, "baseline": F.col("hits_a") / F.col("n_a"), "value": F.col("hits_b") / F.col("n_b")})
    change = F.col("value") - F.col("baseline")
    regressed = (F.col("n_a") >= least) & (F.col("n_b") >= least) & (change >= rise) & (F.abs("z") > stats.Z_01)
    return out.withColumns({"change": change, "regressed": regressed, "severity": F.when(change >= 0.1, "high").otherwise("medium")})


def score_changes(rows: DataFrame, *, keys: list[str], version: str, least: int = 20, drop: float = 0.05, edges: DataFrame | None = None) -> DataFrame:
    """Mean scores that fall by ``drop`` between versions, with a Mann-Whitney |z| beyond the 1 % level."""
    group = [*keys, "before", "after"]
    dealt = sides(rows.filter("value IS NOT NULL"), keys, version, edges)
    means = dealt.groupBy(*group).agg(
        F.avg(F.when(F.col("side") == "a", F.col("value"))).alias("baseline"),
        F.avg(F.when(F.col("side") == "b", F.col("value"))).alias("value")
    )
    out = stats.mann_whitney(dealt, group, "side", "value").alias("t").join(means.alias("m"), _on("t", "m", group)).select("t.*", "m.baseline", "m.value")
    fall = F.col("baseline") - F.col("value")
    regressed = (F.col("n_a") >= least) & (F.col("n_b") >= least) & (fall >= drop) & (F.abs("z") > stats.Z_01)
    return out.withColumns({"regressed": regressed, "severity": F.when(fall >= 0.15, "high").otherwise("medium")})


def prompt_of_run(t: Tables) -> DataFrame:
    """run_id, prompt_version: that of the run's last call which has one and is no judge's."""
    made = own_calls(t).filter("template_version IS NOT NULL AND scorer IS NULL")
    return made.groupBy("run_id").agg(F.max_by("template_version", F.struct("start_time", "span_id")).alias("prompt_version"))


@_built_in("regression")
def regression(t: Tables, *, least: int = 20) -> list[Found]:
    """Version changes that made latency, errors or scores worse.

    Rows are compared only where a series has versions with enough rows that follow each other, which a count by version
    tells first.
    """
    calls = own_calls(t).withColumn("prompt_version", F.col("template_version"))
    steps = t["steps"].filter("executed = 1").withColumns({"latency_ms": F.col("duration_ms"), "code_version": F.col("step_version")})
    scored = scores(t).filter("value IS NOT NULL").join(prompt_of_run(t), "run_id", "left")
    failed = F.col("status").isin(*FAILED)
    of_time = (("latency_ms_median", latency_changes, None), ("error_rate", error_changes, failed))
    series = [
        (calls, ["workflow", "step", "scorer", "model"], "prompt_version", of_time),
        (calls, ["workflow", "step", "scorer"], "model", of_time),
        (steps, ["workflow", "step"], "code_version", of_time),
        (scored, ["workflow", "scorer"], "prompt_version", (("mean_score", score_changes, None),)),
    ]
    edges = [boundaries(rows, keys, version, least=least) for rows, keys, version, _ in series]
    with ThreadPoolExecutor(len(edges)) as pool:
        none = list(pool.map(lambda e: e.isEmpty(), edges))
    out = []
    for (rows, keys, version, checks), found, empty in zip(series, edges, none, strict=True):
        for metric, changes, hit in () if empty else checks:
            compared = changes(rows, keys=keys, version=version, edges=found)
            out.append(_regressions(compared, rows, keys, version, metric, hit))
    return out


def _regressions(changes: DataFrame, rows: DataFrame, keys: list[str], version: str, metric: str, hit: Column | None = None) -> Found:
    """The boundaries that regressed as findings of the new version, with the counts and times of its rows."""
    hit = F.lit(True) if hit is None else hit
    mine = F.when(hit & F.col(version).isNotNull(), F.col("start_time"))
    of_version = rows.groupBy(*keys, version).agg(F.count(mine).alias("hits"), F.min(mine).alias("first_seen"), F.max(mine).alias("last_seen"))
    of_group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    bad = changes.filter("regressed").withColumn(version, F.col("after")).alias("c")
    joined = of_version.alias("v").join(bad, _on("v", "c", [*keys, version])).join(of_group.alias("g"), _on("v", "g", keys))
    found = joined.select(
        *[f"v.{k}" for k in (*keys, version)], F.lit(metric).alias("metric"), "v.hits", "g.total", "c.value", "c.severity",
        F.lit("regression").alias("category"), "v.first_seen", "v.last_seen", "c.baseline", "c.z", F.lit(version).alias("field"),
        "c.before", "c.after",
    )
    hits = rows.filter(hit).select(*keys, version, F.lit(metric).alias("metric"), "span_id", "run_id", "start_time")
    return Found(found, hits, (*keys, version))
