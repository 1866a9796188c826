"""Scalar expressions of the normalization layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a status, and old attribute names with their new ones.
STATUS = {
    "ok": "ok", "error": "error", "unset": "unset", "status_code_ok": "ok", "status_code_error": "error",
    "status_code_unset": "unset", "0": "unset", "1": "ok", "2": "error"
}
CHAT_OPERATIONS = ("chat", "text_completion", "generate_content")
MESSAGE = "array<struct<content:variant,parts:variant>>"


def text_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def iso(ts: Column) -> Column:
    """ISO-8601 UTC with milliseconds, rounded down."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def status_code(raw: Column) -> Column:
    low, out = F.lower(raw.cast("string")), F.lit("unset")
    for spelling, code in STATUS.items():
        out = F.when(low == spelling, code).otherwise(out)
    return out


def duration_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def hex_id(raw: Column, digits: int) -> Column:
    """An id of ``digits`` hex digits stays; any other becomes the first digits of its SHA-256."""
    return F.when(F.lower(raw).rlike(f"^[0-9a-f]{{{digits}}}$"), F.lower(raw)).otherwise(F.substring(F.sha2(raw, 256), 1, digits))


def json_list(raw: Column) -> Column:
    """A JSON list as an array of texts (nested values as JSON); an empty one for anything else."""
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))


def json_map(raw: Column) -> Column:
    """A JSON object as a map of texts; an empty one for anything else."""
    return F.coalesce(F.when(F.startswith(raw, F.lit("{")), F.from_json(raw, "map<string,string>")), F.create_map().cast("map<string,string>"))


def canonical_time(text: Column) -> Column:
    """An ISO time (without a zone: UTC) as ISO UTC with milliseconds, so that times compare as texts; an error for any other."""
    found = F.try_to_timestamp(text)
    return F.when(text.isNull() | found.isNotNull(), iso(found)).otherwise(F.raise_error(F.concat(F.lit("no ISO time: "), text)))


def _pieces(listed: Column) -> Column:
    """Texts of a list (a variant) of pieces: strings, or objects whose type is text."""

    def one(p: Column) -> Column:
        part = lambda name: F.try_variant_get(p, f"$.{name}", "string")
        text = F.when(F.coalesce(part("type"), F.lit("text")) == "text", F.coalesce(part("content"), part("text"), F.lit("")))
        kind = F.schema_of_variant(p)
        return F.when(kind == "STRING", F.try_variant_get(p, "$", "string")).when(F.startswith(kind, F.lit("OBJECT")), text)

    return F.array_compact(F.transform(F.try_variant_get(listed, "$", "array<variant>"), one))


def messages_text(messages: Column) -> Column:
    """Text of a JSON list of messages (content a string or a list of pieces, then parts), or of a plain string.

    Pieces that aren't text are left out, and so are messages of another shape. What only looks like JSON is a plain string.
    """
    none = F.array().cast("array<string>")

    def one(m: Column) -> Column:
        kind = F.schema_of_variant(m["content"])
        said = F.when(kind == "STRING", F.array(F.try_variant_get(m["content"], "$", "string"))).when(F.startswith(kind, F.lit("ARRAY")), _pieces(m["content"]))
        more = F.when(F.startswith(F.schema_of_variant(m["parts"]), F.lit("ARRAY")), _pieces(m["parts"]))
        return F.concat(F.coalesce(said, none), F.coalesce(more, none))

    listed = F.filter(F.from_json(messages, MESSAGE), lambda m: m.isNotNull())
    whole = F.try_parse_json(messages).isNotNull()
    text = F.array_join(F.flatten(F.transform(listed, one)), "\n")
    return F.when(
        F.startswith(messages, F.lit("[")) & whole, F.coalesce(text, F.lit(""))
    ).when(F.startswith(messages, F.lit("{")) & whole, "").otherwise(messages)


def ngram_hashes(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` lower-case words as 64-bit hashes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hashes = lambda w: F.transform(
        F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice(w, i, n))
    )
    return F.array_distinct(F.transform(F.array(words), hashes)[0])


def is_model_call(chat_span: Column, operation: Column, model: Column) -> Column:
    return F.coalesce(chat_span, F.lit(False)) | F.coalesce(operation.isin(*CHAT_OPERATIONS), F.lit(False)) | (operation.isNull() & model.isNotNull())


def finish_reason(raw: Column) -> Column:
    """The first entry of a JSON list; a bare string gives null."""
    return F.get(F.from_json(raw, "array<string>"), F.lit(0))


def since_time(text: str, now=None):
    """A point in time from ISO text or from '30d', '12h', '5m' back from now."""
    import datetime as dt
    import re

    if m := re.fullmatch(r"(\d+)([dhm])", text):
        return (now or dt.datetime.now(dt.UTC)) - dt.timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})
    found = dt.datetime.fromisoformat(text)
    return found if found.tzinfo else found.replace(tzinfo=dt.UTC)
