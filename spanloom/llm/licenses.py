"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Native: DataFrame and SQL functions only.

Tokens are runs of letters and digits, lower-cased. Templates are full texts, standard notices and the phrases that a
notice of one line holds whatever its verb ("under the MIT License", "All rights reserved", SPDX ids). Those of
``LONG`` tokens and more have shingles of five tokens, phrases have shingles of three. A template of n tokens is looked
for in windows of 2n tokens that start every n tokens, so a window always holds the whole of an occurrence. A window that
holds at least ``contain`` of a template's shingles has with it a Jaccard similarity of at least

    J = need / (window's shingles + size - need),   size = template's shingles, need = ceil(contain * size).

Bands are single MinHash values; with b bands a window collides with probability 1 - (1 - J) ** b or more. ``bands_for``
is the least b for which the hardest template of a class misses with a probability of at most ``miss``. The i-th hash of a
shingle is its 64-bit hash xor a constant of the band.

The bands are the only way to a template, and are looked up from the template's side: a window's minimum in a band can
only equal a template's if the window holds the very shingle that gave the template its minimum. The band table is
therefore keyed by these shingles. A text's shingles are looked up there, and for a window with such a key all of its
band values are computed and compared; a window without one collides in no band. What collides is verified exactly, on
the shingles' words. Everything happens inside a document's row: no shuffle at all. The templates are a fixed list (an
array literal in the plan), not data.

Null text, or one of fewer than three tokens, holds no license. Very long texts are scanned whole. Ties, repeated rows and
repeated notices: each name once, in order. Empty table: empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.license_texts import TEMPLATES
from spanloom.llm.native import let, windows

LONG, SHINGLE, SHORT_SHINGLE, CONTAIN, MISS = 11, 5, 3, 0.8, 1e-4


def bands_for(lengths: list[int], shingle: int = SHINGLE, contain: float = CONTAIN, miss: float = MISS) -> int:
    """The least number of single-value bands that keeps every template's miss probability within ``miss``."""
    worst = 1.0
    for n in lengths:
        size = max(1, n - shingle + 1)
        need = math.ceil(contain * size)
        worst = min(worst, need / ((2 * n - shingle + 1) + size - need))
    return math.ceil(math.log(miss) / math.log(1 - worst))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(triples: Column, shingle: int) -> Column:
    """Hashes of the shingles, from those of all runs of three tokens (``triples``): two that overlap make one of five."""
    if shingle == SHORT_SHINGLE:
        return triples
    starts = F.when(F.size(triples) > 2, F.sequence(F.lit(0), F.size(triples) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(triples, i), F.get(triples, i + 2)))


def triples_of(t: Column) -> Column:
    return windows(t, SHORT_SHINGLE, lambda x: F.xxhash64(x))


def signature(shingles: Column, constants: list[int]) -> Column:
    """The least hash of each band; nulls for no shingle."""
    return F.transform(F.lit(constants), lambda c: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(c))))


def constants_of(bands: int) -> list[int]:
    """A constant of each band, from a multiplicative rule."""
    return [(0x9E3779B97F4A7C15 * (i + 1) ^ (0xBF58476D1CE4E5B9 * (i + 1) << 7)) % 2**64 - 2**63 for i in range(bands)]


def templates(spark: SparkSession, texts=TEMPLATES, *, contain: float = CONTAIN, miss: float = MISS) -> list[tuple[int, list, list[int]]]:
    """For each class of templates: shingle, rows (name, n, shingles as text, signature) and the constants of its bands."""
    table = spark.createDataFrame(list(texts), "name string, text string").select("name", tokens(F.col("text")).alias("t"))
    table = table.select("name", F.size("t").alias("n"), "t", triples_of(F.col("t")).alias("triples")).orderBy("name", "n", "t")
    out = []
    for shingle, mine in ((SHINGLE, F.col("n") >= LONG), (SHORT_SHINGLE, F.col("n") < LONG)):
        rows = table.filter(mine)
        if lengths := [r.n for r in rows.select("n").collect()]:
            constants = constants_of(bands_for(lengths, shingle, contain, miss))
            text = F.array_distinct(windows(F.col("t"), shingle, lambda x: F.array_join(x, " ")))
            out.append(
                (
                    shingle,
                    rows.select(
                        "name", "n", text.alias("shingles"),
                        signature(hashes(F.col("triples"), shingle), constants).alias("signature")
                    ).collect(),
                    constants
                )
            )
    return out


def retrieved(t: Column, triples: Column, shingle: int, known: list, constants: list[int], contain: float) -> Column:
    """Matches of one class of templates in a text."""
    keys = sorted({s ^ c for r in known for s, c in zip(r.signature, constants, strict=True)})
    table = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("name"), F.lit(r.n).alias("n"), F.lit(r.shingles).alias("shingles"),
                F.lit(r.signature).alias("signature")
            ) for r in known
        ]
    )
    lengths = F.lit(sorted({r.n for r in known}))
    none = F.array().cast("array<struct<name:string,at:int,containment:double>>")

    def in_window(h: Column, n: Column, j: Column) -> Column:
        piece = F.slice(t, j * n + 1, 2 * n)
        band_values = signature(F.slice(h, j * n + 1, F.greatest(2 * n - (shingle - 1), F.lit(0))), constants)
        near = let(band_values, lambda s: F.filter(table, lambda x: (x["n"] == n) & F.arrays_overlap(x["signature"], s)))

        def verified(found: Column) -> Column:
            share = lambda x, w: F.size(F.array_intersect(x["shingles"], w)) / F.size(x["shingles"])
            exact = lambda w: F.transform(found, lambda x: F.struct(x["name"].alias("name"), (j * n).alias("at"), share(x, w).alias("containment")))
            return F.when(F.size(found) == 0, none).otherwise(
                F.filter(let(windows(piece, shingle, lambda x: F.array_join(x, " ")), exact), lambda m: m["containment"] >= contain)
            )

        return let(near, verified)

    def found(h: Column, hits: Column) -> Column:
        starts = lambda n: F.filter(
            F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(F.floor(p / n).cast("int"), (F.floor(p / n) - 1).cast("int"))))),
            lambda j: j >= 0
        )
        return F.when(F.size(hits) == 0, none).otherwise(
            F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(starts(n), lambda j: in_window(h, n, j)))))
        )

    def per_text(h: Column) -> Column:
        hits = F.filter(F.transform(h, lambda x, i: F.when(x.isin(keys), i)), lambda i: i.isNotNull())
        return let(hits, lambda p: found(h, p))

    return let(hashes(triples, shingle), per_text)


def scan(docs: DataFrame, *, texts=TEMPLATES, contain: float = CONTAIN, miss: float = MISS) -> DataFrame:
    """doc_id, licenses array<string>, matches array<struct<name,at,containment>> (at: the window's first token)."""
    classes = templates(docs.sparkSession, texts, contain=contain, miss=miss)
    per_row = lambda t: let(triples_of(t), lambda x: F.concat(*[retrieved(t, x, *c, contain) for c in classes]))
    out = docs.select("doc_id", let(tokens(F.col("text")), per_row).alias("_m"))
    return out.select("doc_id", F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["name"]))).alias("licenses"), F.array_sort("_m").alias("matches"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))
