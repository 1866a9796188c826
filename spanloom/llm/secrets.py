"""Secret scans: patterns with exact places, and corpus-wide ownership of every candidate value.

Native: DataFrame and SQL functions only.

Places: a text is split at a pattern's matches and the matches are extracted; the lengths of the gaps and matches, summed
from the left, give each match's start in code points. Texts without a candidate skip this.

Base kinds (they always stay): ``assign``, ``access``, ``hex``. The method looks at values of two more kinds that lie in
no base span: ``mixed`` (whole runs of ``[A-Za-z0-9+/_-]``: 16 and more with a digit, an upper- and a lower-case letter, or
24 and more of upper-case letters and digits, both) and ``card`` (whole numbers of 13 to 19 digits, three different ones at
least, with a right check digit). Every candidate value, base or not, is hashed; over the whole corpus its distinct texts,
repositories (``source``, ``lang``) and owners (``source``) are counted. With ``by_text`` (the query has it) copies of one
text count once, as their least repository: a text mirrored by many sources has one owner. A value with more than
``max_owners`` owners, ``max_repositories`` repositories or ``max_texts`` different texts is a widely copied example; any
other looks live. The method adds the spans of live-looking values; base spans carry the same judgement in ``n_live``.

Candidate values are aggregated partially in each task before the shuffle (distinct value, text and repository first, then
texts a repository), so a value that a third of all rows copy is spread over its texts and then one row a repository. The
list of copied values is joined to the candidates alone; a hot value there is split by the engine's skew join.

Null text: empty. Null source or lang counts as one owner of its own. Repeated rows are scanned each by itself. Ties: spans
with one start go by kind. Very long texts are scanned whole. Other columns, whatever their names, are ignored by ``scan``
and kept by ``redact``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.native import let
from spanloom.llm.scratch import materialize

#: kind, pattern, group of the value, least length of the value
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds; which card numbers count is in luhn().
ADDED = (
    (
        "mixed",
        r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{16,}|(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{24,}+(?![a-z+/_-]))",
        0, 16
    ),
    ("card", r"(?<![A-Za-z0-9])[0-9]{13,19}(?![A-Za-z0-9])", 0, 13),
)
MAX_OWNERS, MAX_REPOSITORIES, MAX_TEXTS = 2, 3, 25
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def luhn(number: Column) -> Column:
    """Whether a number's check digit is right and it has three different digits at least."""

    def right(digits: Column) -> Column:
        twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        parts = F.transform(digits, lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
        return (F.size(F.array_distinct(digits)) >= 3) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), right)


def spans_of(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches, as start, end (code points), kind's number and value; short values dropped."""

    def placed(gaps: Column, found: Column, values: Column) -> Column:
        pairs = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(m).alias("m"), F.get(values, i).alias("v")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("s"))

        def add(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["g"]
            span = F.struct(begin.alias("start"), (begin + p["m"]).alias("end"), F.lit(number).alias("kind"), p["v"].alias("value"))
            return F.struct((begin + p["m"]).alias("at"), F.when(F.length(p["v"]) >= least, F.concat(acc["s"], F.array(span))).otherwise(acc["s"]).alias("s"))

        return F.aggregate(pairs, start, add, lambda acc: acc["s"])

    parts = let(
        F.split(text, pattern, -1),
        lambda g: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: placed(g, m, v))
        )
    )
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of spans."""
    text, n = F.coalesce(F.col("text"), F.lit("")), len(KINDS)
    base = F.concat(*[spans_of(text, i, p, g, least) for i, (_, p, g, least) in enumerate(KINDS)])
    mixed, card = (spans_of(text, n + i, p, g, least) for i, (_, p, g, least) in enumerate(ADDED))
    out = docs.withColumn("base", F.array_sort(base)).withColumn("more", F.concat(mixed, F.filter(card, lambda s: luhn(s["value"]))))
    return out.withColumn("more", F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


def owners(found: DataFrame, *, by_text: bool = False) -> DataFrame:
    """value_hash, n_texts, n_repositories, n_owners of every candidate value."""
    values = found.select(F.explode(F.concat("base", "more")).alias("s"), "source", "lang", "text_hash").select(
        F.xxhash64("s.value").alias("value_hash"), "text_hash", F.struct("source", "lang").alias("repository")
    )
    if by_text:
        values = values.groupBy("value_hash", "text_hash").agg(F.min("repository").alias("repository"))
    by = values.distinct().groupBy("value_hash", "repository").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("value_hash").agg(
        F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_repositories"),
        F.countDistinct(F.struct("repository.source")).alias("n_owners")
    )


def scan(
    docs: DataFrame, *, key: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
    max_texts: int = MAX_TEXTS, by_text: bool = False
) -> DataFrame:
    """A row for each row of ``docs``: key, base, more (live-looking only) and live (all live-looking) spans."""
    found = materialize(
        find(
            docs.select(
                key, "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                F.xxhash64("text").alias("text_hash")
            )
        ).drop("text"),
        "secret-spans"
    )
    some = found.filter((F.size("base") > 0) | (F.size("more") > 0)).withColumn("_row", F.monotonically_increasing_id())
    some = materialize(some, "secret-rows")
    counted = owners(some, by_text=by_text).filter(
        (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories) | (F.col("n_texts") > max_texts)
    )
    copied = counted.select("value_hash", F.lit(True).alias("_copied"))
    judged = (
        some.select("_row", F.explode(F.concat("base", "more")).alias("s"))
        .withColumn("value_hash", F.xxhash64("s.value"))
        .join(copied, "value_hash", "left")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.when(F.col("_copied").isNull(), F.col("s")))).alias("live"))
    )
    n = len(KINDS)
    with_live = some.join(judged, "_row").select(key, "base", F.filter("live", lambda s: s["kind"] >= n).alias("more"), "live")
    none = found.filter((F.size("base") == 0) & (F.size("more") == 0)).select(key, "base", "more", F.col("more").alias("live"))
    return with_live.unionAll(none)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, *ADDED)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("b"), s["end"].alias("c"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["b"]), s["a"].cast("string"), s["c"].cast("string"))), ",")


def redact(docs: DataFrame, *, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every live-looking span replaced; widely copied examples stay. All columns as they were."""

    def cut(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def add(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    parts = {"doc_id": F.col("doc_id"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "h": F.xxhash64("text")}
    key = F.struct(*[c.alias(n) for n, c in parts.items()])
    live = scan(docs.select(key.alias("key"), "text", "source", "lang"), key="key", **options).filter(F.size("live") > 0)
    live = live.groupBy(F.col("key").alias("_loom_key")).agg(F.min("live").alias("_loom_live"))
    same = F.lit(True)
    for n, c in parts.items():
        same = same & c.eqNullSafe(F.col(f"_loom_key.{n}"))
    text = F.when(F.col("_loom_live").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("_loom_live")))
    return docs.join(live, same, "left").withColumn("text", text).select(*docs.columns)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), by_text=True)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"),
        F.size("live").cast("long").alias("n_live")
    )
