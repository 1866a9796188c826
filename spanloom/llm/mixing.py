"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then a seeded choice of blocks.

Native: DataFrame and SQL functions only.

1. Sources in code-point order (null last) weigh 5, 2, 1, repeating. ``epochs`` times all tokens is shared by weight;
   a target stops at ``max_repeat`` times its source's tokens and the excess is reshared (water level, in closed form).
2. The targets are votes for equal-token blocks: highest quotients votes / (2k + 1) give each source a whole number of
   blocks, and each source's blocks are dealt to its shards by the same rule with the shards' tokens as votes. The
   quotients' threshold is found by bisection over one row of votes, so no quotient is enumerated.
3. In a shard, documents lie on a line in the order of a seeded hash. A quota of q blocks takes the whole line
   q * block // length times and, of one more round, the consecutive blocks from a seeded starting point (circular).
   A document's part is plain interval arithmetic.

Shards hold about ``shard_rows`` documents, so a source with a third of all rows is many shards and no window sorts
more than a shard. Null text or no words: size 0, taken 0. Null doc_id is a value like others. Very long texts are cut like
others: a part is a range of words. Ties in the seeded order (one doc_id with several texts) go by size, then hash of the
text; rows that are equal in these are interchangeable and lie one after the other. An empty table gives an empty result.
Other columns, whatever their names, are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.native import WORD, let, words
from spanloom.llm.scratch import materialize

WEIGHTS, EPOCHS, MAX_REPEAT, BLOCK, SHARD_ROWS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 64, 10_000, "mix-1"


def seeded(*parts: Column | str) -> Column:
    """A number of 48 bits from texts; any engine that has MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """``parties`` with ``quota`` long: each group's ``seats`` (same in all its rows) by highest quotients.

    Ties go by ``order``. All the votes of a group stand in one array (one number for each source, or each shard of a
    source), over which 80 halvings find the divisor; what remains after it are ties.
    """
    w = Window.partitionBy(*group)
    given = lambda v, d: F.floor(v / d + 0.5).cast("long")

    def halve(acc: Column, all_votes: Column, n: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        over = F.aggregate(all_votes, F.lit(0).cast("long"), lambda a, v: a + given(v, mid)) > n
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    found = (
        parties.groupBy(*group)
        .agg(F.collect_list(F.when(F.col(votes) > 0, F.col(votes).cast("double"))).alias("_v"), F.first(seats).alias("_n"))
        .withColumn(
            "_d",
            F.aggregate(
                F.sequence(F.lit(1), F.lit(80)),
                F.struct(F.lit(0.0).alias("lo"), (F.coalesce(F.array_max("_v"), F.lit(1.0)) * 4 + 1).alias("hi")),
                lambda acc, _: halve(acc, F.col("_v"), F.col("_n")),
            )["hi"],
        )
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_d")
    )
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    first = F.when(F.col(votes) > 0, given(F.col(votes), F.col("_d"))).otherwise(F.lit(0).cast("long"))
    return (
        parties.join(found, on, "inner")
        .withColumn("_q", first)
        .withColumn("_left", F.col(seats) - F.sum("_q").over(w))
        .withColumn("_rank", F.row_number().over(w.orderBy((F.col(votes) / (2 * F.col("_q") + 1)).desc(), *order)))
        .withColumn("quota", F.col("_q") + F.when((F.col("_rank") <= F.col("_left")) & (F.col(votes) > 0), 1).otherwise(0))
        .drop("_q", "_left", "_rank", "_d", *[f"_g{i}" for i in range(len(group))])
    )


def source_targets(sources: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sources`` (source, source_size: a row for each source) with ``target`` double. One row a source is sorted in one task."""
    one = Window.partitionBy(F.lit(0))
    by_ratio = one.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        (F.pmod(F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    level = (
        F.lit(epochs) * F.sum("source_size").over(one) - F.coalesce(
            F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        )
    ) / F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.lit(max_repeat) * F.col("source_size"))
        .withColumn("_level", level)
        .withColumn("_k", F.row_number().over(by_ratio))
        .withColumn("_open", F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct("_k", "_level")))
        .withColumn("_found", F.min("_open").over(one)["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_w") * F.col("_found")), F.col("_cap")))
        .drop("_w", "_cap", "_level", "_k", "_open", "_found")
    )


def assign(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, max_repeat: float = MAX_REPEAT,
    block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED
) -> DataFrame:
    """mix()'s columns and, for each row, ``rounds`` (whole copies) and up to two parts of words, ``first`` and ``second`` (lo, hi)."""
    sized = materialize(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64("text").alias("_hash"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_ord")
        ),
        "mix-sizes",
    )
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), weights=weights,
        epochs=epochs, max_repeat=max_repeat
    )
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(one) / block).cast("long")).withColumn("_all", F.pmod(F.xxhash64("source"), F.lit(1)))
    sources = sainte_lague(sources, ["_all"], "target", "_seats", [F.col("source").asc_nulls_last()])
    sources = materialize(
        sources.select(
            "source", "source_size", "target", F.col("quota").alias("_quota"),
            F.ceil(F.col("_docs") / shard_rows).cast("long").alias("_n")
        ),
        "mix-sources"
    )

    dealt = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d._hash", "d.source", "d.size", "d._ord", "s.source_size", "s.target", "s._quota", (seeded("d._ord") % F.col("s._n")).alias("_shard")
    )
    shards = dealt.groupBy("source", "_shard", "_quota").agg(F.sum("size").alias("_line"))
    shards = sainte_lague(shards, ["source"], "_line", "_quota", [F.col("_shard")]).select(
        F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_line", "quota"
    )

    before = Window.partitionBy("source", "_shard").orderBy("_ord", "size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    total = F.least(F.col("quota") * block, F.floor(F.lit(max_repeat) * F.col("_line")).cast("long"))
    rounds, rest = F.floor(F.col("_total") / F.greatest("_line", F.lit(1))).cast("long"), F.col("_total") % F.greatest("_line", F.lit(1))
    blocks = F.greatest(F.floor(F.col("_line") / block).cast("long"), F.lit(1))
    start = seeded(F.lit(seed), F.coalesce("source", F.lit("null")), F.col("_shard").cast("string")) % blocks * block
    part = lambda lo, hi: F.struct(
        F.greatest(F.lit(0).cast("long"), lo - F.col("_at")).alias("lo"), F.least(F.col("size"), hi - F.col("_at")).alias("hi")
    )
    length = lambda p: F.greatest(F.lit(0).cast("long"), F.col(f"{p}.hi") - F.col(f"{p}.lo"))
    return (
        dealt.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
        .join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
        .withColumn("_total", total)
        .withColumn("rounds", rounds)
        .withColumn("_lo", start)
        .withColumn("_hi", start + rest)
        .withColumn("first", part(F.col("_lo"), F.col("_hi")))
        .withColumn("second", part(F.col("_lo") - F.col("_line"), F.col("_hi") - F.col("_line")))
        .withColumn("taken", F.col("rounds") * F.col("size") + length("first") + length("second"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "_hash", "rounds", "first", "second")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size long, target double, taken long (tokens of the document that the mix holds)."""
    return assign(docs, **options).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: whole copies as they are, parts of a text as its words joined by
    one space (n_chars, if there, is counted anew). A document that the mix leaves out has no row."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[-1]))
    taken = assign(docs, **options).select("doc_id", "_hash", "rounds", "first", "second", "taken").withColumn("_n", nth("doc_id", "_hash")).filter("taken > 0")
    taken = taken.select(F.struct("doc_id", "_hash", "_n", "rounds", "first", "second").alias("_loom"))
    rows = docs.withColumn("_loom_hash", F.xxhash64("text")).withColumn("_loom_n", nth("doc_id", "_loom_hash"))
    joined = rows.join(
        taken,
        F.col("doc_id").eqNullSafe(F.col("_loom.doc_id")) & (F.col("_loom_hash") == F.col("_loom._hash")) & (F.col("_loom_n") == F.col("_loom._n"))
    )
    lo, hi = (lambda p, e=e: F.col(f"_loom.{p}.{e}") for e in ("lo", "hi"))
    cut = lambda w, p: F.array_join(F.slice(w, (lo(p) + 1).cast("int"), (hi(p) - lo(p)).cast("int")), " ")
    parts = let(words(F.col("text")), lambda w: F.array(*[F.when(hi(p) > lo(p), cut(w, p)) for p in ("first", "second")]))
    some = F.greatest(hi("first") - lo("first"), hi("second") - lo("second")) > 0
    parts = F.filter(F.when(some, parts).otherwise(F.array().cast("array<string>")), lambda p: p.isNotNull())
    out = joined.withColumn("text", F.explode(F.concat(F.array_repeat(F.col("text"), F.col("_loom.rounds").cast("int")), parts)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
