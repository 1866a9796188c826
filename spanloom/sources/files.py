"""Span files as DataFrames of raw spans: JSON lines, OTLP/JSON, and exports of two tracing tools."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from spanloom.functions.scalars import hex_id
from spanloom.schemas import SPAN
from spanloom.storage import File, Storage

VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string,bytesValue:string>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
OTLP_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},events:array<struct<name:string,timeUnixNano:string,attributes:{ATTRIBUTES}>>,links:array<struct<traceId:string,spanId:string>>,status:struct<code:string,message:string>>"
SCOPES = f"array<struct<spans:array<{OTLP_SPAN}>>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:{SCOPES},instrumentationLibrarySpans:{SCOPES}>>"
#: Kinds by number.
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")


def text_files(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    return spark.read.text(paths, **options) if paths else spark.createDataFrame([], "value string")


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every JSON document of the files: a file is one document, or one on each line, as its first line tells.

    Files of lines are split like any text; only a file that is one document is read as a whole.
    """
    storage = Storage(spark)
    files = [f for p in ([path] if isinstance(path, str) else path) for f in storage.files(p)]

    def by_line(file: File) -> bool:
        try:
            return isinstance(json.loads(storage.first_line(file, max(1 << 16, min(file.size, 1 << 24)))), (dict, list))
        except ValueError:
            return False

    lines = storage.each(by_line, files)
    of_lines = text_files(spark, [f.path for f, x in zip(files, lines, strict=True) if x])
    whole = text_files(spark, [f.path for f, x in zip(files, lines, strict=True) if not x], wholetext=True)
    return of_lines.unionAll(whole).filter(F.trim("value") != "")


def otlp_values(attributes: Column) -> Column:
    """Attributes with plain values as a map; the last of equal keys counts."""
    value = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["bytesValue"])
    pairs = F.transform(F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("value"), value(a["value"])))
    last = lambda p: F.aggregate(
        p, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
    )
    return last(pairs)


def plain(value):
    """A value of the protocol as a plain one; lists and maps to any depth."""
    if not isinstance(value, dict) or len(value) != 1:
        return value
    ((kind, x),) = value.items()
    if kind == "arrayValue":
        return [plain(v) for v in (x or {}).get("values", [])]
    if kind == "kvlistValue":
        return {e.get("key"): plain(e.get("value")) for e in (x or {}).get("values", [])}
    return int(x) if kind == "intValue" else x


def deep_values(attributes: pd.Series) -> pd.Series:
    """Attributes (JSON of the protocol's list) that hold lists or maps; these become JSON text."""

    def one(text: str | None) -> dict:
        out = {}
        for a in json.loads(text or "[]"):
            raw = a.get("value") or {}
            nested = {k: json.loads(raw[k]) for k in ("arrayValue", "kvlistValue") if raw.get(k)}
            v = plain(nested or {k: x for k, x in raw.items() if x is not None})
            out[a["key"]] = v if isinstance(v, str) else None if v is None or v == {} and not nested else json.dumps(v)
        return out

    return attributes.map(one)


def nanos(raw: Column) -> Column:
    return F.timestamp_micros(F.floor(raw.cast("decimal(20,0)") / 1000).cast("long"))


def otlp(spark: SparkSession, path: str | list[str]) -> DataFrame:
    parsed = documents(spark, path).select(F.explode(F.from_json("value", OTLP)["resourceSpans"]).alias("r"))
    scoped = parsed.select(
        otlp_values(F.col("r.resource.attributes")).alias("resource"),
        F.explode(F.coalesce("r.scopeSpans", "r.instrumentationLibrarySpans")).alias("s")
    )
    spans = scoped.select("resource", F.explode("s.spans").alias("s"))
    # the few spans with lists or maps among their attributes take the way through Python
    deep = F.exists(
        F.coalesce("s.attributes", F.array().cast(ATTRIBUTES)),
        lambda a: a["value"]["arrayValue"].isNotNull() | a["value"]["kvlistValue"].isNotNull()
    )
    flat = spans.filter(~deep).withColumn("attributes", otlp_values(F.col("s.attributes")))
    decode = F.pandas_udf(deep_values, MapType(StringType(), StringType()))
    nested = spans.filter(deep).withColumn("attributes", decode(F.to_json("s.attributes")))
    number = F.col("s.kind").try_cast("int")
    kind = F.when(number.isNotNull(), F.get(F.array(*map(F.lit, KINDS)), number)).otherwise(F.lower(F.regexp_replace("s.kind", "^SPAN_KIND_", "")))
    events = F.transform(
        "s.events",
        lambda e: F.struct(e["name"].alias("name"), nanos(e["timeUnixNano"]).alias("time"), otlp_values(e["attributes"]).alias("attributes"))
    )
    links = F.transform("s.links", lambda x: F.struct(F.lower(x["traceId"]).alias("trace_id"), F.lower(x["spanId"]).alias("span_id")))
    return flat.unionByName(nested).select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"),
        F.nullif(F.lower("s.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"), kind.alias("kind"),
        nanos(F.col("s.startTimeUnixNano")).alias("start_time"), nanos(F.col("s.endTimeUnixNano")).alias("end_time"),
        F.col("s.status").alias("status"), "attributes", events.alias("events"), "resource", links.alias("links"),
    )


def jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Append-only span lines. A torn last line (no line break after it) is left for the next read; any other bad line is
    an error when it is read."""
    storage = Storage(spark)
    files = [f for p in ([path] if isinstance(path, str) else path) for f in storage.files(p, (".jsonl", ".json", ".ndjson"))]
    torn = [(f.path, t) for f, t in zip(files, storage.each(storage.torn_line, files), strict=True) if t]
    lines = text_files(spark, [f.path for f in files])
    if not files:
        return spark.createDataFrame([], SPAN)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    whole = F.try_parse_json("value").isNotNull()
    if torn:  # at most a line a file, of the files that are being written
        tails = F.broadcast(spark.createDataFrame(torn, "_path string, _tail string"))
        mine = F.regexp_replace("_file", "^file:/+", "file:/") == F.regexp_replace("_path", "^file:/+", "file:/")
        lines = lines.join(tails, mine & (F.trim("value") == F.col("_tail")), "left").filter(whole | F.col("_tail").isNull())
    shown = F.concat(F.lit("no JSON in a line of "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80))
    span = F.when(whole, F.from_json("value", SPAN)).otherwise(F.raise_error(shown).cast(f"struct<{SPAN}>"))
    version = F.coalesce(F.get_json_object("value", "$.attributes['hone.schema_version']"), F.get_json_object("value", "$.schema_version"))
    checked = F.when(version.isNull() | (version == "1"), span).otherwise(
        F.raise_error(F.concat(F.lit("schema version "), version, F.lit(" is not 1"))).cast(f"struct<{SPAN}>")
    )
    return lines.select(checked.alias("s")).select("s.*")


def messages_of(raw: Column) -> Column:
    """[{"message.role": .., "message.content": ..}, ..] or [{"message": {..}}, ..] as a JSON list of messages."""
    listed = F.from_json(raw, "array<map<string,string>>")
    part = lambda m, name: F.coalesce(
        F.try_element_at(m, F.lit(f"message.{name}")), F.get_json_object(F.try_element_at(m, F.lit("message")), f"$.{name}"),
        F.try_element_at(m, F.lit(name))
    )
    return F.when(F.size(listed) > 0, F.to_json(F.transform(listed, lambda m: F.struct(part(m, "role").alias("role"), part(m, "content").alias("content")))))


def phoenix(spark: SparkSession, path: str | list[str], *, workflow: str) -> DataFrame:
    """An export (Parquet or JSON lines) with flat ``attributes.*`` columns, or with one ``attributes`` object."""
    paths = [path] if isinstance(path, str) else path
    raw = spark.read.parquet(*paths) if paths[0].endswith(".parquet") else spark.read.json(paths)
    kinds = {f.name: f.dataType.typeName() for f in raw.schema}
    text = lambda n: F.to_json(F.col(f"`{n}`")) if kinds[n] in ("array", "struct", "map") else F.col(f"`{n}`").cast("string")
    null = F.lit(None).cast("string")
    whole = text("attributes") if "attributes" in kinds else null

    def col(name: str) -> Column:
        return text(name) if name in kinds else null

    def attr(name: str) -> Column:
        """A flat column, or the same path in the object (nested, or under its dotted name)."""
        return F.coalesce(col(f"attributes.{name}"), F.get_json_object(whole, f"$.{name}"), F.get_json_object(whole, f"$['{name}']"))

    asked = lambda name: F.get_json_object(attr("llm.invocation_parameters"), f"$.{name}")
    values = {
        "gen_ai.operation.name": F.when(F.upper(F.coalesce(col("span_kind"), attr("openinference.span.kind"))) == "LLM", "chat"),
        "gen_ai.request.model": attr("llm.model_name"),
        "gen_ai.provider.name": attr("llm.provider"),
        "gen_ai.usage.input_tokens": attr("llm.token_count.prompt"),
        "gen_ai.usage.output_tokens": attr("llm.token_count.completion"),
        "gen_ai.request.temperature": asked("temperature"),
        "gen_ai.request.seed": asked("seed"),
        "gen_ai.request.max_tokens": asked("max_tokens"),
        "gen_ai.input.messages": F.coalesce(messages_of(attr("llm.input_messages")), attr("input.value")),
        "gen_ai.output.messages": F.coalesce(messages_of(attr("llm.output_messages")), attr("output.value")),
        "hone.models.prompt.template_version": attr("llm.prompt_template.version"),
        "hone.flow.workflow": F.lit(workflow),
    }
    status = F.struct(col("status_code").alias("code"), col("status_message").alias("message"))
    trace, span = F.coalesce(col("context.trace_id"), col("trace_id")), F.coalesce(col("context.span_id"), col("span_id"))
    return _exported(raw, values, trace, span, col("parent_id"), col("name"), col("start_time"), col("end_time"), status)


LANGFUSE = "struct<id:string,traceId:string,parentObservationId:string,type:string,name:string,startTime:string,endTime:string,model:string,modelParameters:string,input:string,output:string,usageDetails:map<string,string>,usage:map<string,string>,promptName:string,promptVersion:string,calculatedTotalCost:string,level:string,statusMessage:string>"


def langfuse(spark: SparkSession, path: str | list[str], *, workflow: str) -> DataFrame:
    """Observations: a JSON list, ``{"data": [...]}``, one object, or one on each line."""
    parsed = documents(spark, path)
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{LANGFUSE}>"))
    data = F.from_json("value", f"struct<data:array<{LANGFUSE}>>")["data"]
    o = parsed.select(F.explode(F.coalesce(listed, data, F.array(F.from_json("value", LANGFUSE)))).alias("o")).select("o.*")
    used = lambda *names: F.coalesce(*[F.try_element_at(m, F.lit(n)) for m in ("usageDetails", "usage") for n in names])
    values = {
        "gen_ai.operation.name": F.when(F.upper("type") == "GENERATION", "chat"),
        "gen_ai.request.model": F.col("model"),
        "gen_ai.input.messages": F.col("input"),
        "gen_ai.output.messages": F.col("output"),
        "gen_ai.usage.input_tokens": used("input", "promptTokens"),
        "gen_ai.usage.output_tokens": used("output", "completionTokens"),
        "gen_ai.request.temperature": F.get_json_object("modelParameters", "$.temperature"),
        "gen_ai.request.seed": F.get_json_object("modelParameters", "$.seed"),
        "hone.models.prompt.template_id": F.col("promptName"),
        "hone.models.prompt.template_version": F.col("promptVersion"),
        "hone.models.cost_usd": F.col("calculatedTotalCost"),
        "hone.flow.workflow": F.lit(workflow),
    }
    status = F.struct(F.when(F.upper("level") == "ERROR", "error").otherwise("ok").alias("code"), F.col("statusMessage").alias("message"))
    return _exported(
        o, values, F.col("traceId"), F.col("id"), F.col("parentObservationId"), F.coalesce("name", "type"), F.col("startTime"),
        F.col("endTime"), status
    )


def _exported(
    raw: DataFrame, values: dict[str, Column], trace: Column, span: Column, parent: Column, name: Column, start: Column,
    end: Column, status: Column
) -> DataFrame:
    """Raw spans of an export: ids in hex, ISO times, and the attributes that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return raw.select(
        hex_id(trace, 32).alias("trace_id"), hex_id(span, 16).alias("span_id"),
        F.when(parent.isNotNull(), hex_id(parent, 16)).alias("parent_span_id"), name.alias("name"),
        F.lit("internal").alias("kind"), start.try_cast("timestamp").alias("start_time"),
        end.try_cast("timestamp").alias("end_time"), status.alias("status"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("attributes"), *_empty(),
    )


def _empty() -> list[Column]:
    return [
        F.lit(None).cast("array<struct<name:string,time:timestamp,attributes:map<string,string>>>").alias("events"),
        F.create_map().cast("map<string,string>").alias("resource"),
        F.lit(None).cast("array<struct<trace_id:string,span_id:string>>").alias("links")
    ]
