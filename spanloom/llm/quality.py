"""Quality rules with thresholds that adapt to each language and source.

Native: DataFrame and SQL functions only.

Base counts come from one pass over every whole text: array functions inside a row, no explode and no shuffle of words.
Adaptive part: a mergeable quantile sketch for each language, source and measure. A value is rounded down to its
``SKETCH_BITS`` leading bits (in 2 ** -20ths, so a relative error of 1 / 64 at most) and the sketch counts the rounded
values. Two sketches merge by adding counts, in any order: nothing is random, so reruns and retried tasks give the same
thresholds. A sketch has at most some 3,000 entries however many rows it has seen; it is built partially in each task.
A document is rejected where a measure lies beyond the upper fence ``q75 + fence * max(q75 - q25, slack)`` (or below the
lower one, for word length) of its own language and source. The thresholds, a row for each of these, are joined back.

The measures are shares, so long and short texts compare: symbols a word, repeated lines a line, repeated words a word,
words equal to the one before, mean word length. ``slack`` is the smallest spread that counts, so that a source whose
documents are all alike rejects no ordinary one.

Null text has no words (base_failed, since it has fewer than 20). Null language or source is a group of its own; a group
of few documents, even one, has fences from these. Ties share a rounded value and fall together. Repeated rows are judged
each, and alike. Very long texts are measured whole. An empty table gives an empty result; other columns, whatever their
names, are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.native import SPACE, let, windows, words
from spanloom.llm.scratch import materialize

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, SKETCH_BITS = 20, 30, 8, 7
#: Values are sketched in units of 1 / UNIT.
UNIT = 1 << 20
#: measure: (fence in spreads, smallest spread, whether the lower side counts too)
FENCES = {
    "symbols_a_word": (6.0, 0.05, False),
    "dup_lines_a_line": (6.0, 0.06, False),
    "repeats_a_word": (6.0, 0.04, False),
    "stutters_a_word": (6.0, 0.03, False),
    "word_length": (6.0, 0.5, True),
}


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words of the array ``w`` that lie in an ``n``-word window found twice or more in it.

    Hashes of all windows tell most texts apart from those with any repeat; only for these are the windows themselves
    compared, so the count doesn't depend on hashes.
    """

    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(F.lit(n), b - a))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(n), lambda a, x: a + x))

    def starts(s: Column) -> Column:
        same = lambda k, j: F.get(s, k)["x"] == F.get(s, j)["x"]
        found = F.filter(
            F.transform(
                s,
                lambda x, k: F.when((k > 0) & F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"])
            ),
            lambda x: x.isNotNull()
        )
        return F.array_sort(found)

    def exact(items: Column) -> Column:
        texts = windows(items, n, lambda x: F.array_join(x, " "))
        return let(F.array_sort(F.transform(texts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: let(starts(s), covered))

    hashes = windows(w, n, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= n, F.lit(0)).when(let(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h))), F.lit(0)).otherwise(exact(w))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    same = lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    counted = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.when(F.size(w) > 1, same(w)).otherwise(0).cast("long").alias("n_stutters"),
        ),
    )
    return docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), counted.alias("_c"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))
        ).alias("_l"),
    ).select("doc_id", "lang", "source", "_c.n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_l.n").alias("n_lines"), "_c.n_repeat_words", "_c.n_stutters")


def _measures() -> dict[str, Column]:
    at_least_1 = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return {
        "symbols_a_word": F.col("n_symbols") / at_least_1("n_words"),
        "dup_lines_a_line": F.col("n_dup_lines") / at_least_1("n_lines"),
        "repeats_a_word": F.col("n_repeat_words") / at_least_1("n_words"),
        "stutters_a_word": F.col("n_stutters") / at_least_1("n_words"),
        "word_length": F.col("word_chars") / at_least_1("n_words"),
    }


def sketch(counted: DataFrame, *, bits: int = SKETCH_BITS) -> DataFrame:
    """lang, source, measure, value (in units, rounded down to its leading bits), n: the sketches, an entry a row."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(c * UNIT).cast("long").alias("x")) for m, c in _measures().items()])
    low = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("m.x")) - bits, F.lit(0))).cast("long")
    values = counted.select("lang", "source", F.explode(rows).alias("m")).select(
        "lang", "source", "m.measure", (F.col("m.x") - F.col("m.x") % low).alias("value")
    )
    return values.groupBy("lang", "source", "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketches: DataFrame, *, fences: dict = FENCES) -> DataFrame:
    """lang, source and a lower and an upper bound for each measure: quartiles are the first entries that reach their rank."""
    group = Window.partitionBy("lang", "source", "measure")
    up_to = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketches.withColumns({"_up": up_to, "_all": F.sum("n").over(group)})
    q = lambda m, p: F.min(F.when((F.col("measure") == m) & (F.col("_up") >= F.ceil(F.col("_all") * p)), F.col("value"))) / UNIT
    found = ranked.groupBy("lang", "source").agg(*[q(m, p).alias(f"_{m}_{p}") for m in fences for p in (0.25, 0.75)])
    out = [F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    for m, (fence, slack, below) in fences.items():
        low, high = F.col(f"`_{m}_0.25`"), F.col(f"`_{m}_0.75`")
        spread = F.lit(fence) * F.greatest(high - low, F.lit(slack))
        out += [(high + spread).alias(f"_max_{m}"), (low - spread if below else F.lit(float("-inf"))).alias(f"_min_{m}")]
    return found.select(*out)


def judge(docs: DataFrame, *, bits: int = SKETCH_BITS, fences: dict = FENCES) -> DataFrame:
    """The base counts of every document with ``base_failed`` and ``kept``.

    Only documents that pass the base rules shape the thresholds, so much junk in a source doesn't widen its fences.
    """
    counted = measure(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counted = materialize(counted, "quality-counts")
    bounds = thresholds(sketch(counted.filter("NOT base_failed"), bits=bits), fences=fences)
    fits = F.lit(True)
    for m, c in [(m, c) for m, c in _measures().items() if m in fences]:
        fits = fits & c.between(F.col(f"_min_{m}"), F.col(f"_max_{m}"))
    joined = counted.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(*counted.columns, (~F.col("base_failed") & F.coalesce(fits, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were. Rows of one doc_id stand or fall by their own text."""
    parts = {"doc_id": F.col("doc_id"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "h": F.xxhash64("text")}
    key = F.struct(*[c.alias(n) for n, c in parts.items()])
    bad = judge(docs.select(key.alias("doc_id"), "text", "lang", "source"), **options).filter("NOT kept").select(F.col("doc_id").alias("_loom_bad")).distinct()
    same = F.lit(True)
    for n, c in parts.items():
        same = same & c.eqNullSafe(F.col(f"_loom_bad.{n}"))
    return docs.join(bad, same, "left_anti")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
