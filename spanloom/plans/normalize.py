"""Raw spans to canonical spans: one select of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import messages_text, status_code

#: Old attribute names and their new ones.
RENAMED = {
    "gen_ai.system": "gen_ai.provider.name", "gen_ai.usage.prompt_tokens": "gen_ai.usage.input_tokens",
    "gen_ai.usage.completion_tokens": "gen_ai.usage.output_tokens"
}


def renamed(attributes: Column) -> Column:
    """Old names go; their values stay only where the new name is absent."""
    kept = F.map_filter(attributes, lambda k, _: ~k.isin(*RENAMED))
    moved = [
        F.when(
            F.map_contains_key(attributes, F.lit(old)) & ~F.map_contains_key(attributes, F.lit(new)),
            F.create_map(F.lit(new), F.element_at(attributes, F.lit(old)))
        ).otherwise(F.create_map().cast("map<string,string>")) for old,
        new in RENAMED.items()
    ]
    return F.map_concat(kept, *moved)


def legacy_messages(attributes: Column, prefix: str) -> Column:
    """``<prefix>.<n>.role|content`` attributes as a JSON list of messages; null if there are none."""
    pattern = "^" + prefix.replace(".", "\\.") + r"\.(\d+)\.(role|content)$"
    mine = F.map_entries(F.map_filter(attributes, lambda k, _: k.rlike(pattern)))
    numbers = F.array_sort(F.array_distinct(F.transform(mine, lambda e: F.regexp_extract(e["key"], pattern, 1).cast("int"))))
    value = lambda n, part: F.try_element_at(attributes, F.concat(F.lit(f"{prefix}."), n.cast("string"), F.lit(f".{part}")))
    return F.when(
        F.size(numbers) > 0,
        F.to_json(F.transform(numbers, lambda n: F.struct(value(n, "role").alias("role"), value(n, "content").alias("content"))))
    )


def event_messages(events: Column, answers: bool) -> Column:
    """Messages that older traces put into events (prompts, or with ``answers`` the model's choices) as a JSON list; null if there are none."""
    text = lambda e, *names: F.coalesce(*[F.try_element_at(e["attributes"], F.lit(n)) for n in names], F.lit(""))
    if answers:
        role = lambda e: F.lit("assistant")
        mine = lambda e: e["name"].isin("gen_ai.choice", "gen_ai.content.completion")
        said = lambda e: F.coalesce(F.get_json_object(text(e, "message"), "$.content"), text(e, "content"))
        content = lambda e: F.when(e["name"] == "gen_ai.choice", said(e)).otherwise(messages_text(text(e, "gen_ai.completion")))
    else:
        role = lambda e: F.when(e["name"] == "gen_ai.content.prompt", "user").otherwise(F.get(F.split(e["name"], r"\."), F.lit(1)))
        mine = lambda e: e["name"].isin("gen_ai.system.message", "gen_ai.user.message", "gen_ai.assistant.message", "gen_ai.content.prompt")
        content = lambda e: F.when(e["name"] == "gen_ai.content.prompt", messages_text(text(e, "gen_ai.prompt"))).otherwise(text(e, "content"))
    found = F.transform(F.filter(events, mine), lambda e: F.struct(role(e).alias("role"), content(e).alias("content")))
    return F.when(F.size(found) > 0, F.to_json(found))


def with_messages(attributes: Column, events: Column) -> Column:
    """Existing messages are never replaced; indexed attributes go before events."""
    shapes = (("gen_ai.input.messages", "gen_ai.prompt", False), ("gen_ai.output.messages", "gen_ai.completion", True))
    pairs = [
        F.struct(
            F.lit(key).alias("key"),
            F.when(
                ~F.map_contains_key(attributes, F.lit(key)),
                F.coalesce(legacy_messages(attributes, prefix), event_messages(events, answers))
            ).alias("value")
        ) for key,
        prefix, answers in shapes
    ]
    return F.map_concat(attributes, F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())))


def normalize(raw: DataFrame) -> DataFrame:
    """Canonical spans; a span without id, name or start fails the job, as nothing of a bad read should be stored."""
    missing = F.col("span_id").isNull() | F.col("trace_id").isNull() | F.col("name").isNull() | F.col("start_time").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("malformed span: "), F.coalesce("span_id", F.lit("without an id"))))).otherwise(F.col("span_id"))
    attributes = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    return raw.withColumn("attributes", renamed(attributes)).select(
        "trace_id", checked.cast("string").alias("span_id"), "parent_span_id", "name",
        F.coalesce("kind", F.lit("internal")).alias("kind"), "start_time", "end_time",
        F.struct(status_code(F.col("status.code")).alias("code"), F.col("status.message").alias("message")).alias("status"),
        with_messages(F.col("attributes"), F.col("events")).alias("attributes"), "events", "resource", "links",
    )
