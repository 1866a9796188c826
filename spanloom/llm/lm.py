"""Language-model scores from a weighted backoff automaton over words.

Model: the root state has the smoothed probability of every word, (c + 0.1) / (N + 0.1 (V + 1)), over all training
documents. Every n-gram of 1 to ``order - 1`` tokens seen in training is a state. A state h has an arc to each word w that
follows it in training, with the weight

    (c(h w) + s P(w | h')) / (c(h) + s),    s = strengths[len(h) - 1],

where h' is h without its first word, and a failure arc to h' with the weight s / (c(h) + s) for all other words
(Dirichlet smoothing: the pseudo-counts s are shared out as the shorter context predicts). Probabilities of a state sum
to 1. Every n-gram of the training documents counts, those seen once too; nothing is capped or pruned, so the model grows
with the corpus. The end of the text before is the first context of a text.

Traversal goes from left to right: the state is the longest suffix of the last ``order - 1`` tokens that is one. For each
token it follows failure arcs until a state has an arc for it, adds the logs of their weights and the arc's, and goes on.
All tokens of a batch take their k-th step at once, as array operations.

No part of the model is broadcast or sent to the driver:

1. A batch of documents has a block of its words, and for each shard of the hash space a block of its distinct n-grams with
   their counts in training documents (0 where only held-out documents have them).
2. A shard adds up the counts of its blocks and answers each with the whole corpus's counts, in the block's order. A
   common n-gram is one entry a batch. Totals (N, V) are two numbers a shard.
3. Answers meet the batch's block of words, whose n-grams now have their counts, and its documents are traversed.

Shards hold a bounded part of the hash space each (some 2 MB of the table's files) and are read one at a time. Words are
told apart by 64 bits of hashes, longer n-grams by 40 to 64, more in larger tables (hash_bits). Null text: empty, its end is its only token. Null doc_id counts as an empty text in the
hold-out rule. Long texts are read whole (a batch holds at least one). Ties: none, a score depends on counts alone.
Repeated rows are scored, and counted, each. Empty table: empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.pywords import record_batch, rows, window_hashes, word_hashes
from spanloom.llm.scratch import hash_bits, materialize, shards_for

ORDER, ADD, STRENGTHS, BATCH_CHARS = 3, 0.1, (300.0, 20.0), 8_000_000
END = b"\n"  # not a word
SCHEMA = "shard int, batch string, kind int, data binary, ids array<long>"
NAMES, TYPES = ["shard", "batch", "kind", "data", "ids"], [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
BLOCKS_SENT = 32  # of a batch, by one record batch
#: Kinds of blocks: a batch's tokens; its n-grams for a shard, and the answer; a shard's totals.
TOKENS, GRAMS, ANSWER, TOTALS = range(4)


def _planes(a: np.ndarray) -> bytes:
    """The array's bytes, all first ones, then all second ones ...: equal high bytes shrink to nothing. It may be empty."""
    return np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T).tobytes()


@cache
def _zstd():
    """A worker's compressor and decompressor, for blocks so small that making them anew would count."""
    import zstandard

    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return _zstd()[0].compress(head + b"".join(_planes(a) for a in arrays))


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    data = _zstd()[1].decompress(data)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(np.frombuffer(data, "<u4", len(kinds)).tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, "u1", n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def squeeze(words: bytes, held: bytes) -> bytes:
    """A batch's words (a line for each text) and its hold-out flags, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(9).compress(np.array([len(held)], "<u4").tobytes() + held + words)


def unsqueeze(data: bytes) -> tuple[list[list[bytes]], np.ndarray]:
    """The tokens of each text of a batch, and which are held out."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    held = np.frombuffer(data, "u1", n, 4).astype(bool)
    return [[*line.split(), END] for line in data[4 + n :].split(b"\n")], held


def hashes_of(read: list[list[bytes]]) -> np.ndarray:
    """Hashes of the tokens of all texts, an end before each."""
    return word_hashes([t for tokens in read for t in (END, *tokens)])


def text_of_place(sizes: np.ndarray) -> np.ndarray:
    """The text of each place; a text of n tokens has n + 1, as the end before it has one."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes.astype(np.int64) + 1)


def grams(hashes: np.ndarray, text: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``k``-grams of a batch, as sorted hashes, the places (last tokens) of all, and which each is.

    ``hashes``: the tokens of all texts, an end before each text; that end isn't one of its tokens.
    """
    first = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if k > 1 else np.flatnonzero(np.concatenate([[False], text[1:] == text[:-1]]))
    keys, which = np.unique(window_hashes(hashes, k)[first] >> np.uint64(64 - bits), return_inverse=True)
    return keys, (first + (k - 1)).astype(np.int32), which.astype(np.int32)


def shard_ends(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Ends of the shards' parts of sorted ``keys``: a shard is a range of hashes."""
    of = ((keys >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(shards + 1).astype(np.uint64))


def send(order: int, shards: int, bits: int, batch_chars: int):
    """(doc_id, held_out, text) to a batch's block of tokens and its blocks of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, kept, read, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            batch, sizes = f"{task}-{number}", np.array([len(t) for t in read], "<u4")
            held = np.array([h for _, h in kept], bool)
            words = squeeze(b"\n".join(b" ".join(t[:-1]) for t in read), held.astype("u1").tobytes())
            yield record_batch(NAMES, TYPES, [(zlib.crc32(batch.encode()) % shards, batch, TOKENS, words, [d for d, _ in kept])])
            every, text = hashes_of(read), text_of_place(sizes)
            read.clear()
            del words
            found = []
            for k in range(1, order + 1):
                width = 64 if k == 1 else bits
                keys, at, which = grams(every, text, k, width)
                ends, steps = shard_ends(keys, shards, width), np.diff(keys, prepend=np.uint64(0))
                first = ends[:-1][ends[:-1] < ends[1:]]
                steps[first] = keys[first]  # a block's first key stands whole, the others as steps from the one before
                found.append((steps, np.bincount(which, ~held[text[at]], len(keys)).astype("<u4"), ends.tolist()))
                del keys, at, which
            blocks: list[tuple] = []
            for s in range(shards):
                out = [x[ends[s] : ends[s + 1]] for steps, counts, ends in found for x in (steps, counts)]
                if any(map(len, out)):  # the more shards, the fewer n-grams of a batch are in one: some lengths may have none
                    blocks.append((s, batch, GRAMS, _pack(*out), None))
                if len(blocks) == BLOCKS_SENT or blocks and s == shards - 1:
                    yield record_batch(NAMES, TYPES, blocks)
                    blocks = []

        for doc_id, held, text in rows(batches):
            kept.append((doc_id, held))
            read.append([*(text or "").encode("utf-8", "surrogatepass").lower().split(), END])
            chars += len(text or "")
            if chars >= batch_chars:
                yield from flush()
                number, kept, read, chars = number + 1, [], [], 0
        if kept:
            yield from flush()

    return run


def add_up(order: int):
    """A shard's blocks of n-grams to the counts in the whole corpus, block by block, and its totals. Tokens pass."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        batches: list[str] = []
        parts: list[list[np.ndarray]] = [[] for _ in range(2 * order)]
        shard = 0
        for shard, batch, kind, data, ids in rows(iter(table.to_batches())):
            if kind == TOKENS:
                out.append((shard, batch, kind, data, ids))
            else:
                batches.append(batch)
                for i, a in enumerate(_unpack(data, ["<u8", "<u4"] * order)):
                    parts[i].append(np.cumsum(a, dtype=np.uint64) if i % 2 == 0 else a)
        answers: list[list[np.ndarray]] = [[] for _ in batches]
        for k in range(order if batches else 0):
            ends = np.cumsum([len(x) for x in parts[2 * k]])
            keys, counts = np.concatenate(parts[2 * k]), np.concatenate(parts[2 * k + 1])
            parts[2 * k], parts[2 * k + 1] = [], []
            by_key = np.argsort(keys)
            keys = keys[by_key]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
            totals = np.add.reduceat(counts[by_key].astype("<u8"), first) if len(keys) else np.empty(0, "<u8")
            if k == 0:
                out.append((shard, "", TOTALS, None, [int(totals.sum()), int((totals > 0).sum())]))
            answer = np.empty(len(keys), "<u8")
            answer[by_key] = np.repeat(totals, np.diff(np.append(first, len(keys))))
            del by_key, keys, counts
            for i, part in enumerate(np.split(answer, ends[:-1])):
                answers[i].append(part)
        out += [(shard, batch, ANSWER, _pack(*a), None) for batch, a in zip(batches, answers, strict=True)]
        return pa.Table.from_batches([record_batch(NAMES, TYPES, out)])

    return run


def traverse(order: int, bits: int, add: float, strengths: tuple[float, ...], total: int, distinct: int):
    """A batch's tokens and answers to its documents' scores."""
    size = total + add * (distinct + 1)

    def run(table: pa.Table) -> pa.Table:
        all_rows = list(rows(iter(table.to_batches())))
        doc_ids, (read, held) = next((r[4], unsqueeze(r[3])) for r in all_rows if r[2] == TOKENS)
        sizes = np.array([len(t) for t in read], "<u4")
        every, text = hashes_of(read), text_of_place(sizes)
        read.clear()
        answers = [_unpack(r[3], ["<u8"] * order) for r in sorted((r for r in all_rows if r[2] == ANSWER), key=lambda r: r[0])]
        places = len(text)
        seen = []  # by order: the count of the n-gram that ends at a place, 0 where a text has none
        for k in range(order):
            counts = np.zeros(places)
            _, at, which = grams(every, text, k + 1, 64 if k == 0 else bits)
            counts[at] = np.concatenate([a[k] for a in answers])[which]
            seen.append(counts)
        # the end before a text is a context as often as texts have ends
        start = np.concatenate([[True], text[1:] != text[:-1]])
        ends = np.concatenate([start[1:], [True]])
        as_context = [np.where(start, seen[0][ends][0], seen[0]), *seen[1:]]
        root = (seen[0] + add) / size
        low, failures = root, np.zeros(places)
        for k in range(1, order):
            context = np.zeros(places)
            context[1:] = as_context[k - 1][:-1]
            context[start] = 0
            fail = strengths[k - 1] / (context + strengths[k - 1])  # 1 where there is no such state
            low = seen[k] / (context + strengths[k - 1]) + fail * low
            failures += (context > 0) & (seen[k] == 0)
        mine = ~start
        first = np.searchsorted(text[mine], np.arange(len(sizes)))
        per_text = lambda x: np.add.reduceat(x[mine], first)
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array(held), pa.array(sizes.astype(np.int64)), pa.array(per_text((seen[0] > 0).astype(np.int64))),
            pa.array(per_text(np.log10(root))), pa.array(per_text(np.log10(low))), pa.array(per_text(failures).astype(np.int64)),
        ]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "failures"])

    return run


def score(docs: DataFrame, *, order: int = ORDER, add: float = ADD, strengths: tuple[float, ...] = STRENGTHS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, failures (failure arcs followed), vocabulary."""
    shards, bits = shards_for(docs, 2 << 20), hash_bits(docs)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = texts.mapInArrow(send(order, shards, bits, batch_chars), SCHEMA)
    counted = materialize(sent.groupBy("shard").applyInArrow(add_up(order), SCHEMA), "lm-counts")
    totals = counted.filter(F.col("kind") == TOTALS).agg(F.sum(F.col("ids")[0]).alias("n"), F.sum(F.col("ids")[1]).alias("v")).first()
    total, distinct = int(totals.n or 0), int(totals.v or 0)
    scored = counted.filter(F.col("kind") != TOTALS).groupBy("batch").applyInArrow(
        traverse(order, bits, add, strengths, total, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, failures long"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        "failures", F.lit(distinct).cast("long").alias("vocabulary")
    )


def op9_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
