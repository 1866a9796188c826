"""Output analysis: vectors of the outputs of a step, clusters, measures of sameness, and what the outputs copy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import SpanloomError
from spanloom.functions import stats
from spanloom.functions.scalars import messages_text, ngram_hashes
from spanloom.operators import vectors
from spanloom.operators.detectors import _on
from spanloom.operators.rates import Found
from spanloom.plans.derive import attribute
from spanloom.scratch import materialize

KEYS = ["workflow", "step"]
LEAST_OUTPUTS, BATCH = 20, 256
PATTERN_SHARE, LEAST_DISTINCT, RISE = 0.2, 0.5, 0.1
NO_SECTIONS = "no prompt sections are recorded for these outputs, so no section can be named as the cause"


def embed(texts: DataFrame, embedder, cache: DataFrame | None = None) -> DataFrame:
    """text_sha, embedding (unit length) of the distinct texts of ``texts`` (text, text_sha).

    ``cache``: model, text_sha, embedding. What it holds for the embedder's model, with the right number of dimensions,
    isn't embedded again. The rest goes to the embedder on the executors, in batches of 256 texts; it has to be picklable.
    """
    model, size = embedder.model_id, embedder.dimensions
    distinct = texts.groupBy("text_sha").agg(F.first("text").alias("text"))
    known = None
    if cache is not None:
        known = cache.filter((F.col("model") == model) & (F.size("embedding") == size)).select("text_sha", "embedding")
        distinct = distinct.join(known, "text_sha", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a : a + BATCH]
                found = embedder.embed(part["text"].tolist())
                if len(found) != len(part) or any(len(v) != size for v in found):
                    raise SpanloomError(f"{model} gave {len(found)} vectors for {len(part)} texts, or not of {size} dimensions")
                yield pd.DataFrame({"text_sha": part["text_sha"].to_numpy(), "embedding": [list(map(float, v)) for v in found]})

    fresh = distinct.select("text_sha", "text").mapInPandas(run, "text_sha string, embedding array<double>")
    fresh = fresh.select("text_sha", vectors.unit(F.col("embedding")).alias("embedding"))
    return fresh if known is None else fresh.unionByName(known)


def large_groups(outputs: DataFrame, least: int = LEAST_OUTPUTS) -> DataFrame:
    """The outputs of the groups of ``least`` and more."""
    groups = outputs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return outputs.alias("l").join(groups.alias("r"), _on("l", "r", KEYS), "left_semi")


def clustered(outputs: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """``outputs`` with embedding, cluster, center, nearest, sampled and cluster_id."""
    with_vectors = outputs.join(embeddings, "text_sha")
    found = vectors.clusters(with_vectors.select(*KEYS, "span_id", "embedding"), KEYS, "span_id", "embedding", **options)
    named = F.concat_ws("/", F.coalesce("workflow", F.lit("None")), F.coalesce("step", F.lit("None")), "center")
    found = found.withColumn("cluster_id", F.when(F.col("cluster") >= 0, F.concat(F.lit("C-"), F.substring(F.sha2(named, 256), 1, 8))))
    return with_vectors.alias("l").join(found.alias("r"), F.col("l.span_id") == F.col("r.span_id")).select(
        "l.*", "r.cluster", "r.center", "r.nearest", "r.sampled", "r.cluster_id"
    )


def cluster_table(rows: DataFrame) -> DataFrame:
    """id, workflow, step, rank, size, total, center of each cluster."""
    total = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"))
    sizes = rows.filter("cluster >= 0").groupBy(*KEYS, "cluster_id", "cluster", "center").agg(F.count(F.lit(1)).alias("size"))
    return sizes.alias("l").join(total.alias("r"), _on("l", "r", KEYS)).select(
        F.col("l.cluster_id").alias("id"), "l.workflow", "l.step", F.col("l.cluster").alias("rank"), "l.size", "r.total",
        "l.center"
    )


def distinct_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outputs, distinct_rate: the share of different texts."""
    by_sha = rows.groupBy(*keys, "text_sha").agg(F.count(F.lit(1)).alias("_n"))
    return by_sha.groupBy(*keys).agg(F.sum("_n").alias("outputs"), (F.count(F.lit(1)) / F.sum("_n")).alias("distinct_rate"))


def repeated_ngrams(rows: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """keys, repeated_ngram_rate: of the n-grams (each once for an output that has it), those of more than one output.

    n-grams go on as 64-bit hashes, counted partially in each task.
    """
    grams = ngram_hashes(F.col("text"), n)
    by = rows.select(*keys, F.explode(grams).alias("_g")).groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c"))
    return by.groupBy(*keys).agg((F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("repeated_ngram_rate"))


def measures(rows: DataFrame) -> DataFrame:
    """workflow, step, outputs, mean_pairwise_cosine, largest_cluster_share, distinct_rate, repeated_ngram_rate, clusters."""
    shares = rows.groupBy(*KEYS).agg(
        (F.count_if(F.col("cluster") == 0) / F.count(F.lit(1))).alias("largest_cluster_share"),
        (F.max("cluster") + 1).alias("clusters")
    )
    cosine = vectors.mean_pairwise(rows.filter("sampled"), KEYS, "embedding").withColumnRenamed("mean_pairwise", "mean_pairwise_cosine")
    out = distinct_rate(rows, KEYS)
    for more, name in ((shares, None), (cosine, "mean_pairwise_cosine"), (repeated_ngrams(rows, KEYS), "repeated_ngram_rate")):
        wanted = [f"r.{name}"] if name else ["r.largest_cluster_share", "r.clusters"]
        out = out.alias("l").join(more.alias("r"), _on("l", "r", KEYS), "left").select("l.*", *wanted)
    return out.withColumn("repeated_ngram_rate", F.coalesce("repeated_ngram_rate", F.lit(0.0)))


def shares_by_version(rows: DataFrame) -> DataFrame:
    """For each step: share of the largest cluster by prompt version, the least of them, and whether it rose.

    It rose if the last version's share (versions by first appearance) is 10 points above the first's, beyond the 1 % level.
    """
    by = rows.filter("template_version IS NOT NULL").groupBy(*KEYS, "template_version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") == 0).alias("top"), F.min(F.struct("start_time", "span_id")).alias("seen")
    )
    listed = by.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seen", "template_version", "n", "top"))).alias("v"))
    a, b = F.col("v")[0], F.element_at("v", -1)
    z = stats.two_proportion_z(b["top"], b["n"], a["top"], a["n"])
    rose = (F.size("v") > 1) & (b["top"] / b["n"] - a["top"] / a["n"] >= RISE) & (F.abs(z) > stats.Z_01)
    share = lambda x: F.struct(x["template_version"].alias("version"), (x["top"] / x["n"]).alias("share"))
    least = F.when(F.size("v") > 1, F.array_min(F.transform("v", lambda x: x["top"] / x["n"])))
    return listed.select(*KEYS, F.map_from_entries(F.transform("v", share)).alias("by_prompt_version"), least.alias("baseline"), rose.alias("rose"))


def homogeneity(rows: DataFrame, measured: DataFrame) -> Found:
    """Steps whose largest cluster holds a fifth of the outputs, or grew with a prompt version, and steps with few distinct
    outputs. ``rows``: clustered()."""
    joined = measured.alias("l").join(shares_by_version(rows).alias("r"), _on("l", "r", KEYS), "left")
    share, all_of = F.col("l.largest_cluster_share"), F.struct(
        "l.outputs", "l.mean_pairwise_cosine", "l.largest_cluster_share", "l.distinct_rate", "l.repeated_ngram_rate", "l.clusters"
    )
    mine = rows.filter("cluster = 0").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("hits"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"),
        F.first("cluster_id").alias("cluster_id")
    )
    pattern = joined.join(mine.alias("m"), _on("l", "m", KEYS)).filter((share >= PATTERN_SHARE) | F.coalesce("r.rose", F.lit(False)))
    pattern = pattern.select(
        "l.workflow", "l.step", F.lit("largest_cluster_share").alias("metric"), "m.hits", F.col("l.outputs").alias("total"),
        share.alias("value"),
        F.when(share >= 0.3, "high").when(share >= PATTERN_SHARE, "medium").otherwise("low").alias("severity"),
        F.lit("diversity").alias("category"), "m.first_seen", "m.last_seen", F.col("r.baseline").alias("baseline"),
        F.lit("homogeneity").alias("detector"), "m.cluster_id", "r.by_prompt_version", all_of.alias("measures"),
    )
    twice = repeated_first(rows)
    copies = twice.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hits"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"))
    few = measured.alias("l").join(copies.alias("m"), _on("l", "m", KEYS)).filter(F.col("l.distinct_rate") < LEAST_DISTINCT)
    few = few.select(
        "l.workflow", "l.step", F.lit("distinct_rate").alias("metric"), "m.hits", F.col("l.outputs").alias("total"),
        F.col("l.distinct_rate").alias("value"), F.lit("high").alias("severity"), F.lit("diversity").alias("category"),
        "m.first_seen", "m.last_seen", F.lit(1.0).alias("baseline"), F.lit("homogeneity").alias("detector"),
        all_of.alias("measures"),
    )
    members = rows.filter("cluster = 0").select(*KEYS, F.lit("largest_cluster_share").alias("metric"), "span_id", "run_id", "start_time")
    firsts = twice.select(*KEYS, F.lit("distinct_rate").alias("metric"), "span_id", "run_id", "start_time")
    return Found(pattern.unionByName(few, allowMissingColumns=True), members.unionByName(firsts), tuple(KEYS))


def repeated_first(rows: DataFrame) -> DataFrame:
    """Of each text that a step gave more than once, the first output."""
    by = rows.groupBy(*KEYS, "text_sha").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("start_time", "span_id", "run_id")).alias("_f"))
    return by.filter("_n > 1").select(*KEYS, "_f.*")


def outliers(rows: DataFrame) -> Found:
    """Outputs whose nearest neighbour lies below the lower fence median - 6 * max(median - q25, 0.02) of their step."""
    q = stats.quantiles(rows, KEYS, "nearest", {"q25": 0.25, "q50": 0.5})
    low = F.col("r.q50") - 6 * F.greatest(F.col("r.q50") - F.col("r.q25"), F.lit(0.02))
    far = rows.alias("l").join(q.alias("r"), _on("l", "r", KEYS)).filter(F.col("l.nearest") < low).select("l.*")
    total = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"))
    by = far.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("hits"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen")
    ).filter("hits >= 3")
    found = by.alias("l").join(total.alias("r"), _on("l", "r", KEYS)).filter(F.col("r.total") >= LEAST_OUTPUTS).select(
        "l.workflow", "l.step", F.lit("outlier_rate").alias("metric"), "l.hits", "r.total",
        (F.col("l.hits") / F.col("r.total")).alias("value"), F.lit("low").alias("severity"), F.lit("quality").alias("category"),
        "l.first_seen", "l.last_seen", F.lit(0.0).alias("baseline"), F.lit("outliers").alias("detector"),
    )
    return Found(found, far.select(*KEYS, F.lit("outlier_rate").alias("metric"), "span_id", "run_id", "start_time"), tuple(KEYS))


def section_texts(spans: DataFrame, outputs: DataFrame, calls: DataFrame) -> DataFrame:
    """workflow, step, section, version, text, text_sha: each section as the first call of the outputs that has it shows it."""
    mine = calls.filter(F.size("sections") > 0).join(outputs.select("span_id"), "span_id", "left_semi")
    each = mine.select(*KEYS, "span_id", "start_time", F.explode("sections").alias("s")).filter("s.start IS NOT NULL AND s.end IS NOT NULL")
    first = each.groupBy(
        *KEYS, F.col("s.id").alias("section"), F.col("s.version").alias("version")
    ).agg(F.min(F.struct("start_time", "span_id", "s.start", "s.end")).alias("f"))
    prompt = messages_text(attribute("gen_ai.input.messages"))
    found = first.select(*KEYS, "section", "version", "f.*").join(spans.select("span_id", prompt.alias("prompt")), "span_id")
    text = F.substring(F.col("prompt"), F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select(*KEYS, "section", "version", text.alias("text")).filter(F.trim("text") != "").withColumn("text_sha", F.sha2("text", 256))


def analyze_outputs(
    spans: DataFrame, outputs: DataFrame, calls: DataFrame, embedder, cache: DataFrame | None = None
) -> tuple[list[Found], DataFrame, DataFrame, DataFrame]:
    """Findings, the clustered outputs, what each section shares with the largest cluster, and all embeddings used."""
    large = large_groups(outputs)
    sections = materialize(section_texts(spans, large, calls), "sections")
    texts = large.select("text", "text_sha").unionByName(sections.select("text", "text_sha"))
    embeddings = materialize(embed(texts, embedder, cache), "embeddings")
    rows = materialize(clustered(large, embeddings), "clustered")
    found = [homogeneity(rows, materialize(measures(rows), "measures")), outliers(rows)]
    with_vectors = sections.join(embeddings.withColumnRenamed("embedding", "section_embedding"), "text_sha")
    return found, rows, vectors.closeness(rows, with_vectors, KEYS), embeddings
