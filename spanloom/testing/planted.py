"""Runs with planted problems, as one DataFrame plan: any number of runs, no driver loop, the same rows for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.derive import CHAT_SPAN, ITEM, MODEL, RUN, RUN_SPAN, STEP, STEP_SPAN, WORKFLOW

FLOW, GENERATOR, SAME, OTHER = "song_ideas", "lab/alpha-7b", "lab/alpha-judge", "lab/beta-judge"
#: The prompt's sections; the plant ``homogeneity`` adds the example from version 3 on, and most outputs copy it.
ROLE = "You invent ideas for songs. "
EXAMPLE = "For example: an old lighthouse keeper counts passing ships through winter fog until morning. "
COPIED = "an old lighthouse keeper counts passing ships through winter fog, number "
#: Plant to the metric that must show it and the share of rows it touches.
TRUTH = {
    "truncation": ("truncation_rate", 0.05),
    "same_family": ("same_family_judge_share", 1.0),
    "zero_spike": ("zero_score_rate", 0.1),
    "capability": ("capability_error_rate", 1.0),
    "swaps": ("model_swaps_per_run", 1.0),
    "stale_source": ("stale_source_rate", 0.15),
    "repeats": ("unseeded_repeat_rate", 0.3),
    "slower": ("latency_ms_median", None),
    "homogeneity": ("largest_cluster_share", 0.4),
}


def planted_spans(spark: SparkSession, runs: int, plants: tuple[str, ...] = tuple(TRUTH), *, seed: int = 0) -> DataFrame:
    """Raw spans: a run span (two in every fifth run), a step, a generator's call, a score, a decision, a judge's call.

    Prompt version 2 in the first half, then 3; with the plant ``slower`` the last quarter has version 4, 1.8 times
    slower. ``capability`` adds a judge's call that a model refuses.
    """
    on = lambda plant: F.lit(plant in plants)
    chance = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    version = F.when(F.col("id") < runs // 2, 2).when((F.col("id") < runs * 3 // 4) | ~on("slower"), 3).otherwise(4)
    base = spark.range(runs).select(
        "id", version.alias("version"), (F.lit(1_767_225_600_000_000) + F.col("id") * 60_000_000).alias("at"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("run"), F.md5(F.concat_ws("/", F.lit(seed), "id")).alias("trace"),
        *[chance(c).alias(f"u_{c}") for c in ("length", "zero", "repeat", "stale", "time", "score", "again", "seed", "copy")],
    )
    slow = F.when(F.col("version") == 4, 1.8).otherwise(1.0)
    took = (F.lit(900_000) * slow * (0.75 + 0.5 * F.col("u_time"))).cast("long")
    resumed = F.col("id") % 5 == 0
    stale = on("stale_source") & resumed & (F.col("u_stale") < TRUTH["stale_source"][1])
    length = on("truncation") & (F.col("u_length") < TRUTH["truncation"][1])
    zero = on("zero_spike") & (F.col("u_zero") < TRUTH["zero_spike"][1])
    repeat = on("repeats") & (F.col("u_repeat") < TRUTH["repeats"][1])
    task = F.when(
        repeat, F.concat(F.lit("idea about topic "), F.floor(F.col("u_again") * 4).cast("string"))
    ).otherwise(F.concat(F.lit("idea about run "), "run"))
    with_example = on("homogeneity") & (F.col("version") >= 3)
    copies = with_example & (F.col("u_copy") < 0.8)
    # two dozen of three hundred words: any two texts share a few
    word = lambda i: F.translate(F.pmod(F.xxhash64("trace", i), F.lit(300)).cast("string"), "0123456789", "bdfgklmnrs")
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.lit("o"), word(i))), " ")
    said = F.when(copies, F.concat(F.lit(COPIED), F.col("id").cast("string"))).otherwise(own)
    section = lambda name, start, end: f'{{"id": "{name}", "version": "1", "start": {start}, "end": {end}}}'
    role, example = section("role", 0, len(ROLE)), section("example", len(ROLE), len(ROLE) + len(EXAMPLE))
    sections = F.when(with_example, f"[{role}, {example}]").otherwise(f"[{role}]")
    judge = F.when(on("same_family"), SAME).otherwise(OTHER)
    prompt = F.concat(F.lit(ROLE), F.when(with_example, EXAMPLE).otherwise(""), task)
    message = lambda role, text: F.to_json(F.array(F.struct(F.lit(role).alias("role"), text.alias("content"))))

    def span(
        number: int, name: str, lasts: Column | int, attributes: dict[str, Column], *, error: Column | None = None,
        events: Column | None = None, when: Column | None = None
    ) -> Column:
        own = {WORKFLOW: F.lit(FLOW), RUN: F.col("run"), STEP: F.lit("ideas"), ITEM: F.lit("0")} | attributes
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in own.items()]), lambda p: p["value"].isNotNull())
        start = F.col("at") + number * 5_000_000
        lasts = lasts if isinstance(lasts, Column) else F.lit(lasts)
        failed = F.lit(None).cast("string") if error is None else error
        row = F.struct(
            F.col("trace").alias("trace_id"),
            F.substring(F.md5(F.concat_ws("/", "trace", F.lit(number))), 1, 16).alias("span_id"),
            F.lit(None).cast("string").alias("parent_span_id"), F.lit(name).alias("name"), F.lit("internal").alias("kind"),
            F.timestamp_micros(start).alias("start_time"), F.timestamp_micros(start + lasts).alias("end_time"),
            F.struct(F.when(failed.isNull(), "ok").otherwise("error").alias("code"), failed.alias("message")).alias("status"),
            F.map_from_entries(pairs).alias("attributes"),
            (F.array() if events is None else events).cast("array<struct<name:string,time:timestamp,attributes:map<string,string>>>").alias("events"),
            F.create_map().cast("map<string,string>").alias("resource"),
            F.array().cast("array<struct<trace_id:string,span_id:string>>").alias("links"),
        )
        return row if when is None else F.when(when, row)

    warning = F.struct(
        F.lit("warning").alias("name"), F.timestamp_micros("at").alias("time"),
        F.create_map(F.lit("kind"), F.lit("source_changed_version_unchanged"), F.lit("step"), F.lit("ideas")).alias("attributes")
    )
    chat = {"gen_ai.operation.name": F.lit("chat"), "hone.models.gpu.unloaded": F.when(on("swaps"), 1)}
    ranked = F.to_json(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("total")) for i, t in (("a", 0.8), ("b", 0.5))]))
    spans = [
        span(0, RUN_SPAN, 40_000_000, {"hone.flow.status": F.lit("done")}),
        span(1, STEP_SPAN, 30_000_000, {"hone.flow.status": F.lit("done"), "hone.flow.step_version": F.lit("1")}),
        span(
            2, CHAT_SPAN, took,
            {
                "gen_ai.operation.name": F.lit("chat"), MODEL: F.lit(GENERATOR),
                "hone.models.prompt.template_version": F.col("version"),
                "gen_ai.response.finish_reasons": F.when(length, '["length"]').otherwise('["stop"]'),
                "gen_ai.usage.input_tokens": F.lit(800), "gen_ai.request.seed": F.floor(F.col("u_seed") * 1e6),
                "gen_ai.input.messages": message("user", prompt), "gen_ai.output.messages": message("assistant", said),
                "hone.models.prompt.sections": sections
            }
        ),
        span(3, CHAT_SPAN, 300_000, chat | {MODEL: judge, "hone.scorer": F.lit("quality")}),
        span(
            4, "hone.select.score", 1_000,
            {
                "hone.select.scorer": F.lit("quality"), "hone.candidate_id": F.lit("a"),
                "hone.select.score.value": F.when(zero, 0.0).otherwise(0.4 + 0.5 * F.col("u_score")),
                "hone.select.score.error": F.when(zero, "no number in the answer")
            }
        ),
        span(5, "hone.select.decision", 1_000, {"hone.select.ranked": ranked, "hone.select.winner_id": F.lit("a")}),
        span(
            6, CHAT_SPAN, 200_000,
            {"gen_ai.operation.name": F.lit("chat"), MODEL: F.lit(OTHER), "hone.scorer": F.lit("cover_art")},
            error=F.lit("HTTP 400: images are not supported"), when=on("capability")
        ),
        span(
            7, RUN_SPAN, 1_000, {"hone.flow.status": F.lit("done")},
            events=F.when(stale, F.array(warning)).otherwise(
                F.array().cast("array<struct<name:string,time:timestamp,attributes:map<string,string>>>")
            ),
            when=resumed
        ),
    ]
    return base.select(F.explode(F.filter(F.array(*spans), lambda s: s.isNotNull())).alias("s")).select("s.*")
