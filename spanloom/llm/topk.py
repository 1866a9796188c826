"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors become floor(scale * x). They are dealt to shards of some ``shard_rows`` rows; each shard's ball tree is built
once and written. The nodes of a tree are taken in the order of their upper bound <q, center> + |q| * radius; a node whose
bound is below the query's current kth score is dropped with all that follows it.

The queries go over the shards in blocks of at most about ``block`` queries, so what a job carries along is bounded.
Every block visits the shards in two waves: the first eighth, and then, with the kth score that these shards found
together, all others. So every tree of the second wave is searched from a bound that many shards share; a tree raises it
further as leaves are read. A shard returns k rows at most for each query, and the k best of all shards win.

Scores are whole numbers: float64 products are exact below 2 ** 53, int64 below 2 ** 63, and Python's integers serve
beyond. A component that is no 64-bit integer, or a score among the results that is none, is an error, never wrapped.

Vectors that are null or hold null or non-finite components take no part; vectors of another length than the
query's aren't its candidates. Ties go to the smaller vec_id. Repeated rows are rows of their own: a query's candidates
are all rows but its own. Fewer than k candidates: all of them. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.scratch import materialize, partitions

K, SCALE, EVERY, LEAF, BLOCK, SHARD_ROWS, WAVES = 5, 256, 50, 128, 4096, 20_000, 8
LIMIT = 2**63


class BallTree:
    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        nodes: list[tuple[int, int, int, int]] = []  # start, end, children (or -1)
        centers, radii = [], []

        def build(a: int, b: int) -> int:
            part = vectors[self.order[a:b]]
            center = part.mean(axis=0)
            far = np.sqrt(((part - center) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append((a, b, -1, -1))
            centers.append(center)
            radii.append(far.max())
            if b - a > leaf and radii[me] > 0:
                pole = part[far.argmax()]
                other = part[((part - pole) ** 2).sum(axis=1).argmax()]
                side = part @ (other - pole)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
                nodes[me] = (a, b, build(a, a + half), build(a + half, b))
            return me

        build(0, len(vectors))
        self.nodes, self.centers, self.radii = nodes, np.array(centers), np.array(radii)

    def packed(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, nodes=np.array(self.nodes, np.int64), centers=self.centers, radii=self.radii, **more)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> tuple["BallTree", dict[str, np.ndarray]]:
        found = dict(np.load(io.BytesIO(data)))
        tree = cls.__new__(cls)
        tree.order, tree.centers, tree.radii = found.pop("order"), found.pop("centers"), found.pop("radii")
        tree.nodes = [tuple(n) for n in found.pop("nodes").tolist()]
        return tree, found

    def search(self, q: np.ndarray, score, best: list[tuple[int, int]], k: int, kth: float) -> list[tuple[int, int]]:
        """``best``: (-score, vec_id) sorted. ``score(rows)`` gives (scores, ids) of a leaf's rows, the query's own left out."""
        bounds = self.centers @ q + math.sqrt(float(q @ q)) * self.radii
        bounds += 1e-9 * (np.abs(bounds) + 1)  # rounding never drops a node
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            a, b, left, right = self.nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            scores, ids = score(self.order[a:b])
            near = scores >= kth
            if near.any():
                best = sorted(best + list(zip((-scores[near]).tolist(), ids[near].tolist(), strict=True)))[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
        return best


def _by_length(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, vec_id, vector) of the rows, for each length of vectors."""
    table = table.combine_chunks()
    uids, ids = (table.column(c).to_numpy() for c in ("uid", "vec_id"))
    v = table.column("v").combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), 0))
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield uids[at], ids[at], v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """In what <a, b> is exact."""
    most = max(map(abs, (int(a.min(initial=0)), int(a.max(initial=0))))) * max(map(abs, (int(b.min(initial=0)), int(b.max(initial=0))))) * max(1, a.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < LIMIT else object


def build_tree(table: pa.Table) -> pa.Table:
    """A shard's rows to its trees, one for each length of vectors."""
    shard = table.column("shard")[0].as_py()
    out = [(shard, v.shape[1], BallTree(v.astype(np.float64)).packed(uids=u, ids=i, vectors=v)) for u, i, v in _by_length(table)]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "d", "tree"])


def search_trees(queries: dict[int, tuple[np.ndarray, np.ndarray]], bounds: dict[int, float], k: int):
    """``queries``: uids and vectors by length; ``bounds``: a lower bound of a query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d not in queries:
                    continue
                tree, rows = BallTree.unpacked(data.as_py())
                uids, ids = rows["uids"], rows["ids"]
                kind = _exact(rows["vectors"], queries[d][1])
                exact, out = rows["vectors"].astype(kind), []
                for uid, q in zip(queries[d][0].tolist(), queries[d][1], strict=True):
                    qk = q.astype(kind)

                    def score(at: np.ndarray, uid=uid, qk=qk) -> tuple[np.ndarray, np.ndarray]:
                        at = at[uids[at] != uid]
                        found = exact[at] @ qk
                        return (found.astype(np.int64) if kind is np.float64 else found), ids[at]

                    out += [(uid, -s, i) for s, i in tree.search(q.astype(np.float64), score, [], k, bounds.get(uid, -math.inf))]
                if kind is object and any(not -LIMIT <= s < LIMIT for _, s, _ in out):
                    raise OverflowError("a score is no 64-bit integer; use a smaller scale")
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, shard_rows: int = SHARD_ROWS, waves: int = WAVES) -> DataFrame:
    """uid, query_id, rank, vec_id, score. Both inputs: uid, vec_id long, v array<long>; a query's own uid is left out."""
    blocks = max(1, -(-queries.count() // block))
    shards = max(partitions(vectors.sparkSession), -(-vectors.count() // shard_rows))
    dealt = vectors.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "uid", "vec_id", "v")
    trees = materialize(dealt.groupBy("shard").applyInArrow(build_tree, "shard int, d int, tree binary"), "topk-trees")
    early = F.col("shard") % waves == 0
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    parts: list[DataFrame] = []
    for b in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "vec_id", "v").toArrow()
        by_length = {v.shape[1]: (u, v) for u, _, v in _by_length(asked)} if asked.num_rows else {}
        bounds: dict[int, float] = {}
        for wave in (early, ~early):
            found = trees.filter(wave).select("d", "tree").mapInArrow(search_trees(by_length, bounds, k), "uid long, score long, vec_id long")
            parts.append(materialize(found, "topk-found"))
            if wave is early:  # a number for each query of the block
                bounds = {r.uid: r.score for r in ranked(parts[-1]).filter(F.col("rank") == k).select("uid", "score").collect()}
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return ranked(found).join(queries.select("uid", F.col("vec_id").alias("query_id")), "uid").select(
        "uid", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def whole_vectors(table: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, v: the usable rows, numbered. A component beyond 64 bits is an error."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))
    scaled = lambda c: F.lit(float(scale)) * c
    whole = lambda c: F.when(F.abs(scaled(c)) < float(LIMIT), F.floor(scaled(c))).otherwise(
        F.raise_error(F.lit("an embedding's component is no 64-bit integer; use a smaller scale")).cast("long")
    )
    spread = table.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    return materialize(spread.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v"), "topk-vectors")


def op4_of(embeddings: DataFrame) -> DataFrame:
    vectors = whole_vectors(embeddings)
    return top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(EVERY)) == 0)).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return op4_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
