"""N-gram Jaccard join: MinHash candidates, Bayesian pruning hash by hash, exact verification.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is ``threshold`` or more (a text of one
to four words is one shingle).

1. Equal word sequences are one node (with its number of copies), so copies are never expanded into pairs.
2. Each node has a MinHash signature of ``BANDS * ROWS`` values. Nodes that agree on a band are candidates: a pair at
   0.8 misses every band with a probability of (1 - 0.8 ** 5) ** 25 = 5e-5, a closer one more rarely.
3. Candidates compare their MinHash values a few at a time. With a uniform prior, m of n equal values leave a posterior
   P(J >= t) = P(Bin(n + 1, t) <= m); a pair is dropped as soon as that is below ``tolerance``. What survives goes on as
   a spanning forest (a row or less for each member of a bucket), never as pairs.
4. The forest's connected components hold every surviving pair. Inside them all similarities are exact, from products of
   blocks of the document-by-shingle matrix: links are counted and a forest of links is returned; its components are the
   classes.

Buckets and components of more than ``block`` members are dealt into blocks, and pairs of blocks are tasks of their own;
a task never holds more than about two blocks. The number of exact links of a very large group of near copies grows
with its square, since none may be lost; they are counted inside tasks and never become rows.

Null or wordless texts are in a class of their own and link to nothing, also not to each other. Rows with a null doc_id
are left out of all links and have a null class. Repeated rows count as copies. One doc_id may have several texts, each
in its own class (class_text tells them apart). Ties: a pair at exactly the threshold is linked. Other columns, whatever
their names, are ignored, and kept by ``keep_one``. Empty table: empty result. Very long texts are shingled whole. Nodes
are named by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.pywords import record_batch, rows, window_hashes, word_hashes, words
from spanloom.llm.scratch import materialize, partitions

SHINGLE, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE, BLOCK = 5, 0.8, 25, 5, 25, 1e-5, 512
K = BANDS * ROWS
_random = np.random.default_rng(20240229)
FACTORS = (_random.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1)).tolist()
SHIFTS = _random.integers(0, 2**32, K, dtype=np.uint32).tolist()


def shingles(items: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(window_hashes(word_hashes(items), min(SHINGLE, len(items)))) if items else np.empty(0, np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """K MinHash values, of which 16 bits are kept."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    a, b = np.array(FACTORS, np.uint32)[:, None], np.array(SHIFTS, np.uint32)[:, None]
    least = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (a * x[None, i : i + 2048] + b).min(axis=1))
    return (least ^ (least >> np.uint32(16))).astype("<u2")


def node_of(items: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(items)) - 2**63


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text_hash, text in rows(iter([batch])):
            w = words(text)
            out.append((doc_id, text_hash, node_of(w) if w else None, signature(shingles(w)).tobytes() if w else None))
        yield record_batch(["doc_id", "text_hash", "node", "signature"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = 0..K: the least number of equal values that keeps P(J >= threshold | m of n) >= tolerance."""
    out = []
    for n in range(K + 1):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(s: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (i, j) of the signatures ``s`` pass every step."""
    alive, matched = np.arange(len(i)), np.zeros(len(i), np.int32)
    for at in range(0, K, STEP):
        matched = matched + (s[i[alive], at : at + STEP] == s[j[alive], at : at + STEP]).sum(axis=1, dtype=np.int32)
        fine = matched >= least[min(K, at + STEP)]
        alive, matched = alive[fine], matched[fine]
    return alive


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) for the nodes that aren't the least."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            low, high = (a, b) if nodes[a] < nodes[b] else (b, a)
            root[high] = low
    return [(int(nodes[x]), int(nodes[find(x)])) for x in range(len(nodes)) if find(x) != x]


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``width`` columns, of sorted input."""
    key, kept = None, []
    for row in rows(batches):
        if row[:width] != key:
            if kept:
                yield kept
            key, kept = row[:width], []
        kept.append(row)
    if kept:
        yield kept


def pairs_of(side: np.ndarray, crossed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members, in portions: all of one block, or those of two blocks with one of each."""
    n = len(side)
    if crossed:
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
        for a in left:
            yield np.full(len(right), a), right
    else:
        portion: list[np.ndarray] = []
        for a in range(n - 1):
            portion.append(np.stack([np.full(n - 1 - a, a), np.arange(a + 1, n)]))
            if sum(p.shape[1] for p in portion) > 20_000 or a == n - 2:
                i, j = np.concatenate(portion, axis=1)
                portion = []
                yield i, j


def candidates(threshold: float, tolerance: float):
    """Sorted rows band, low, high, side, node, signature to edges of a forest of surviving pairs."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches, 3):
            if len(group) > 1:
                nodes, s = np.array([g[4] for g in group]), np.frombuffer(b"".join(g[5] for g in group), "<u2").reshape(-1, K)
                side, found = np.array([g[3] for g in group]), []
                for i, j in pairs_of(side, group[0][1] != group[0][2]):
                    alive = survivors(s, i, j, least)
                    found.append(np.stack([i[alive], j[alive]]))
                if found:
                    out += forest(nodes, *np.concatenate(found, axis=1))
            if len(out) > 10_000:
                yield record_batch(["a", "b"], [pa.int64(), pa.int64()], out)
                out = []
        yield record_batch(["a", "b"], [pa.int64(), pa.int64()], out)

    return run


def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, node, comp, copies to node, comp, copies, shingles; rows whose text is not the node's are left out."""
    for batch in batches:
        out = []
        for text, node, comp, copies in rows(iter([batch])):
            w = words(text)
            if w and node_of(w) == node:
                out.append((node, comp, copies, shingles(w).tobytes()))
        yield record_batch(["node", "comp", "copies", "shingles"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)


def verify(threshold: float):
    """Sorted rows comp, low, high, side, node, copies, shingles to (node, linked copies, least linked node)."""

    def intersections(sets: list[np.ndarray]) -> np.ndarray:
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shared = np.flatnonzero(np.bincount(at, minlength=len(every)) > 1)
        place = np.full(len(every), -1)
        place[shared] = np.arange(len(shared))
        column = place[at]
        out = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, 8_000_000 // len(sets))  # a strip of the matrix at a time
        for a in range(0, len(shared), width):
            some = (column >= a) & (column < a + width)
            strip = np.zeros((len(sets), min(width, len(shared) - a)), np.float32)
            strip[holder[some], column[some] - a] = 1
            out += strip @ strip.T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches, 3):
            nodes, copies, side = (np.array([g[k] for g in group]) for k in (4, 5, 3))
            sets = [np.frombuffer(g[6], "<u8") for g in group]
            size = np.array([len(x) for x in sets])
            both = intersections(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3
            np.fill_diagonal(linked, False)
            if group[0][1] != group[0][2]:
                linked &= side[:, None] != side[None, :]
            exact = linked & (both / (size[:, None] + size[None, :] - both) >= threshold - 1e-9)
            least = dict(forest(nodes, *np.nonzero(np.triu(exact))))
            out += [(int(n), int(c), least.get(int(n), int(n))) for n, c in zip(nodes, exact @ copies, strict=True) if c]
            if len(out) > 10_000:
                yield record_batch(["node", "links", "least"], [pa.int64()] * 3, out)
                out = []
        yield record_batch(["node", "links", "least"], [pa.int64()] * 3, out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's name) for all nodes of the edges (a, b).

    Every node is merged into the least of itself and its neighbours, again and again until no edge is left: the graph
    shrinks by half or more each time. Tables of a round are written, so a lost executor costs a task.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = materialize(both.groupBy(F.col("a").alias("x")).agg(F.least(F.col("x"), F.min("b")).alias("y")), "cc-step")
        steps.append(merged)
        edges = edges.join(merged, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        edges = edges.join(merged, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = steps[0].select(F.col("x").alias("node"), F.col("y").alias("comp"))
    for step in steps[1:]:
        out = out.join(step, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("y", "comp").alias("comp"))
    return materialize(out, "cc-components")


def dealt(members: DataFrame, size: str, block: int) -> DataFrame:
    """``members`` with low, high, side: a row for each pair of blocks that a member's own block is part of."""
    n, side = F.ceil(F.col(size) / block).cast("int"), F.col("side")
    out = members.withColumn("_n", n).withColumn("side", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    return out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns(
        {"low": F.least(side, F.col("_o")), "high": F.greatest(side, F.col("_o"))}
    ).drop("_n", "_o")


def classify(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) of the rows, and (node, comp, first, n_links) of the nodes.

    ``first`` is the least (doc_id, text_hash) of the class, so two texts that share a doc_id have classes of their own.
    """
    n = partitions(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.col("text").cast("string").alias("text")
    )
    signed = materialize(texts.mapInArrow(sign, "doc_id long, text_hash long, node long, signature binary"), "near-signed")
    usable = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first_row")
    nodes = materialize(usable.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")), "near-nodes")

    hashed = [F.xxhash64(F.lit(b), F.substring("signature", 1 + 2 * ROWS * b, 2 * ROWS)) for b in range(BANDS)]
    bands = nodes.select("node", F.explode(F.array(*hashed)).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = dealt(bands.join(shared, "band"), "size", block).join(nodes.select("node", "signature"), "node")
    keyed = members.select("band", "low", "high", "side", "node", "signature").repartition(n, "band", "low", "high").sortWithinPartitions("band", "low", "high")
    rough = components(keyed.mapInArrow(candidates(threshold, tolerance), "a long, b long"))

    sizes = rough.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    chosen = rough.join(nodes.select("node", "first_row", "copies"), "node").select(
        "node", "comp", "copies", F.col("first_row.doc_id").alias("doc_id"), F.col("first_row.text_hash").alias("text_hash")
    )
    sets = texts.join(chosen, ["doc_id", "text_hash"]).select("text", "node", "comp", "copies").mapInArrow(
        read_sets, "node long, comp long, copies long, shingles binary"
    )
    sets = materialize(sets, "near-sets").dropDuplicates(["node"])
    keyed = dealt(sets.join(sizes, "comp"), "size", block).select(
        "comp", "low", "high", "side", "node", "copies", "shingles"
    ).repartition(n, "comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    links = materialize(keyed.mapInArrow(verify(threshold), "node long, links long, least long"), "near-links")

    classes = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "first_row", "copies").join(counted, "node", "left").join(classes, "node", "left")
    known = known.withColumn("comp", F.coalesce("comp", "node"))
    named = known.groupBy("comp").agg(F.min("first_row").alias("first"))
    known = known.join(named, "comp").select("node", "comp", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_hash", "node"), known


def join_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_text, n_links: a row for each row of ``docs``.

    class_id is the least doc_id of the class and class_text the hash of that document's text, which tells classes apart
    where a doc_id has several texts. n_links is the number of other documents at ``threshold`` or more, copies included.
    """
    signed, known = classify(docs, **options)
    out = signed.join(known, "node", "left")
    linked = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(linked, F.coalesce("first.doc_id", "doc_id")).alias("class_id"),
        F.when(linked, F.coalesce("first.text_hash", "text_hash")).alias("class_text"),
        F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the least (doc_id, hash of text), and of its repeated rows the least by the
    other columns. Rows without a word or a doc_id are in no class of several, so all of them stay."""
    _, known = classify(docs, **options)
    firsts = known.select("first").distinct().select(F.col("first.doc_id").alias("_loom_id"), F.col("first.text_hash").alias("_loom_hash"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    here = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    kept = docs.filter(~alone).join(firsts, (here[0] == F.col("_loom_id")) & (here[1] == F.col("_loom_hash")))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_loom_0")))
    nth = F.row_number().over(Window.partitionBy("_loom_id", "_loom_hash").orderBy(rest))
    return kept.withColumn("_loom_n", nth).filter("_loom_n = 1").select(*docs.columns).unionAll(docs.filter(alone))


def op6_near(spark, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_text")
