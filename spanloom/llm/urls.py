"""URL filters: rules for hosts and paths, and for the rest a logistic regression on hashed character n-grams.

Native: DataFrame and SQL functions only; nothing but the weights (``2 ** bits`` doubles) passes through the driver.

The labelled table is small by contract: at most ``train_rows`` urls that a rule decides, those with the smallest hash of
host and path, half for each verdict, and stays that small however many pages there are. Training is full-batch gradient descent with
L2, written as array functions over one row that holds the examples. The trained weights are an array literal of
``2 ** bits + 1`` doubles in the plan of the scoring pass.

Null url or one without ``://``: empty host and path, no rule; the model judges it by its bias and the border n-gram.
Very long urls are hashed whole, in time that grows with their length. With fewer than two verdicts among the labelled
urls, every weight is 0 and what no rule decides is allowed. Ties: the longest rule that fits wins, of rules of one length
the later one of the list; a score of exactly 0 allows. Repeated rows get the same verdict. Other columns, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.native import let
from spanloom.llm.scratch import materialize

#: rule, verdict. A rule is a host, then a path from its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
NGRAMS, BITS, TRAIN_ROWS, STEPS, RATE, L2 = (3, 4), 10, 400, 60, 8.0, 1e-4


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, r"(?s)^.*?://", "")).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null for none."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(text: Column, *, ngrams=NGRAMS, bits: int = BITS) -> Column:
    """Buckets (1-based) of the character n-grams of ``^text$``; an empty text has those of its borders alone."""
    characters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")

    def grams(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.slice(c, i, n)), F.lit(1 << bits)) + 1).cast("int"))

    return let(characters, lambda c: F.concat(*[grams(c, n) for n in ngrams]))


def _logit(weights: Column, buckets: Column) -> Column:
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return F.get(weights, F.lit(0)) + total / F.sqrt(F.size(buckets).cast("double"))


def train(labelled: DataFrame, *, bits: int = BITS, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> list[float]:
    """Bias, then a weight for each bucket. ``labelled``: x array<int>, y double; a bounded table.

    One row holds the examples and, for each bucket, the examples that have it; a step reads both. All steps are one
    array expression, so the result doesn't depend on how tasks are cut.
    """
    size = 1 << bits
    examples = labelled.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("e"))
    held = F.transform("e", lambda r, i: F.transform(r["x"], lambda b: F.struct(b.alias("b"), i.alias("i"))))
    lists = examples.select("e", F.explode(F.flatten(held)).alias("h")).groupBy("h.b").agg(F.array_sort(F.collect_list("h.i")).alias("i"))
    by_bucket = F.map_from_entries(F.collect_list(F.struct("b", "i")))
    # written, so that no step computes the lists again
    one = materialize(
        examples.withColumn("m", lists.agg(by_bucket).scalar()).select(
            "e",
            F.transform(
                F.sequence(F.lit(0), F.lit(size)),
                lambda b: F.when(b == 0, F.sequence(F.lit(0), F.size("e") - 1)).otherwise(
                    F.coalesce(F.try_element_at("m", b), F.array().cast("array<int>"))
                )
            ).alias("lists")
        ),
        "url-examples"
    )

    def step(w: Column) -> Column:
        miss = lambda r: (r["y"] - 1 / (1 + F.exp(-_logit(w, r["x"])))) / F.size("e")
        errors = F.transform("e", lambda r: let(miss(r), lambda d: F.struct(d.alias("bias"), (d / F.sqrt(F.size(r["x"]).cast("double"))).alias("part"))))
        down = lambda e: F.transform(
            w,
            lambda v, j: v + F.lit(rate) * (
                F.aggregate(
                    F.get("lists", j), F.lit(0.0),
                    lambda a, i: a + F.when(j == 0, F.get(e, i)["bias"]).otherwise(F.get(e, i)["part"])
                ) - F.lit(l2) * v
            )
        )
        return let(errors, down)

    start = F.array_repeat(F.lit(0.0), size + 1)
    trained = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda w, _: step(w))
    found = one.select(trained.alias("w")).first()
    return list(found["w"]) if found and found["w"] else [0.0] * (size + 1)


def judge(
    pages: DataFrame, *, rules=RULES, ngrams=NGRAMS, bits: int = BITS, train_rows: int = TRAIN_ROWS, steps: int = STEPS,
    rate: float = RATE, l2: float = L2, labelled: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, logit. ``labelled`` (host, path, verdict): another small labelled table."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "_says": verdict})
    if labelled is None:
        known = urls.filter("rule IS NOT NULL").groupBy("host", "path").agg(F.first("_says").alias("verdict"))
        order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
        sides = [known.filter(F.col("verdict") == v).orderBy(*order).limit(train_rows // 2) for v in ("allow", "block")]
        labelled = sides[0].unionAll(sides[1])
    x = features(F.concat("host", "path"), ngrams=ngrams, bits=bits)
    table = materialize(labelled.select(x.alias("x"), (F.col("verdict") == "block").cast("double").alias("y")), "url-labels")
    verdicts = {r[0] for r in table.select("y").distinct().collect()}
    weights = train(table, bits=bits, steps=steps, rate=rate, l2=l2) if len(verdicts) == 2 else [0.0] * ((1 << bits) + 1)
    logit = let(x, lambda b: _logit(F.lit(weights), b))
    return urls.withColumn("logit", F.when(F.col("rule").isNull(), logit)).select(
        "page_id", "host", "path", "rule", F.coalesce("_says", F.when(F.col("logit") > 0, "block").otherwise("allow")).alias("verdict"), "logit"
    )


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
