"""Packing token sequences: best-fit decreasing, over all documents at once.

1. Tokenize (Arrow batches, each text whole): an id array for each document; id ``end`` is added. A document is cut into
   full windows and one rest; only doc_id, start, length and a checksum of each piece go on.
2. Best-fit decreasing works on lengths, not on documents: the number of rests of each length (at most 2048 numbers,
   whatever the corpus) is all it needs. A segment tree indexed by remaining capacity finds the tightest open window;
   windows with the same remaining capacity are filled together, as ranges of window numbers, so the plan has a few
   rows for each length.
3. Each rest has a rank among those of its length (a count per bucket of documents, then a rank inside the bucket: a
   hot length is spread over all buckets) and the plan turns a rank into a window and an offset. The plan is broadcast;
   its size is bounded by the window's length.

Null text: empty, so one id. Repeated rows are packed each; ties in a length go by bucket, then doc_id. Very long
texts become as many full windows as they hold. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import binascii
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.scratch import materialize, partitions

SIZE, END, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Entries of a worker's word cache, and the longest word kept in it.
CACHE, CACHED_CHARS = 800_000, 64


class SegmentTree:
    """Counts by remaining capacity; ``tightest(n)`` is the least capacity >= n with an open window, or -1."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.full = [False] * (2 * self.leaves)

    def set(self, at: int, some: bool) -> None:
        at += self.leaves
        self.full[at] = some
        while at > 1:
            at //= 2
            self.full[at] = self.full[2 * at] or self.full[2 * at + 1]

    def tightest(self, least: int) -> int:
        at = least + self.leaves
        if self.full[at]:
            return least
        while at > 1:
            if not at & 1 and self.full[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.full[2 * at])
                return at - self.leaves
            at //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, from_rank, to_rank, first_window, per_window, offset) and the number of windows.

    Pieces of a length, numbered from 0, that have ranks in [from_rank, to_rank) lie in window first_window +
    (rank - from_rank) // per_window at offset + (rank - from_rank) % per_window * length.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity: ranges (first window, number)
    tree, rows, made = SegmentTree(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def put(room: int, first: int, number: int) -> None:
            if room and number:
                open_[room].append((first, number))
                tree.set(room, True)

        while left:
            room = tree.tightest(length)
            if room < 0:  # open new windows, all at once
                per = size // length
                first, number, room = made, -(-left // per), size
                made += number
            else:
                first, number = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
                per = room // length
            whole, part = min(number, left // per), 0
            if whole < number and left - whole * per:
                part = left - whole * per
            used = whole + bool(part)
            placed = whole * per + part
            rows.append((length, rank, rank + placed, first, per, size - room))
            rank, left = rank + placed, left - placed
            put(room - per * length, first, whole)
            if part:
                put(room - part * length, first + whole, 1)
            put(room, first + used, number - used) if room < size else None
    return rows, made


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """A dictionary of two generations: when it is full, the older half goes and the newer one becomes the older."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def put(self, key: str, value):
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of single words, remembered; the same ids as the tokenizer's own for a whole text.

    White space never shares a token with anything, so a text's ids are those of its words. A word of plain Latin
    letters (no combining marks, no letters whose lower case depends on their place) is cut by the tokenizer's own
    pattern and its parts go straight to its model; any other word goes through the whole tokenizer. Ids are kept as
    little-endian unsigned 32-bit numbers, so a text is a join of bytes.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        steps = json.loads(self.whole.to_str())
        parts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = [x["type"] for x in parts] == ["Split", "ByteLevel"] and [
            x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        self.cut = regex.compile(parts[0]["pattern"]["Regex"]).findall if known else None
        self.plain = regex.compile(r"[\x21-\x7E\xC0-\u024F]+").fullmatch
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tokenize = self.whole.model.tokenize
        self.words, self.parts = Remembered(CACHE), Remembered(CACHE)

    def part(self, x: str) -> bytes:
        ids = self.parts.old.get(x)
        if ids is None:
            ids = np.array([t.id for t in self.tokenize(x if x.isascii() else self.bytes(x)[0][0])], "<u4").tobytes()
        return self.parts.put(x, ids)

    def word(self, w: str) -> bytes:
        if not w:
            return b""
        ids = self.words.old.get(w)
        if ids is None:
            low = w.lower()
            if self.cut and w.isascii() and w.isalpha():
                ids = self.parts.get(low) or self.part(low)
            elif self.cut and self.plain(w):
                ids = b"".join([self.parts.get(x) or self.part(x) for x in self.cut(low)])
            else:
                ids = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return self.words.put(w, ids)

    def text(self, text: str, end: int) -> np.ndarray:
        last = np.array([end], "<u4").tobytes()
        if "<|" in text:  # may hold the string of a special token, which can span anything
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            get, word = self.words.get, self.word
            ids = b"".join([get(w) or word(w) for w in text.replace("\n", " ").split(" ")])
        return np.frombuffer(ids + last, "<u4")


def piece_batches(path: str | None, size: int, end: int, name: str = TOKENIZER):
    """A mapInArrow function: text to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers

        # one encoder for all the tasks that a worker process runs
        kept = tokenizers.__dict__.setdefault("_spanloom_encoders", {})
        where = path or tokenizer_path(name)
        encoder = kept.get(where) or kept.setdefault(where, WordEncoder(where))
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.text(text.as_py() or "", end)
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    out.append((doc, start, len(piece), binascii.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, *[pa.int64()] * 4), strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return run


def pack(docs: DataFrame, *, size: int = SIZE, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long): a row for each piece."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = text.mapInArrow(piece_batches(path, size, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    buckets = partitions(spark)
    pieces = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")), "pack-pieces")

    by_bucket = materialize(pieces.groupBy("length", "bucket").count(), "pack-counts")
    counts = {r.length: r.n for r in by_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    full = counts.pop(size, 0)
    rows, made = best_fit_decreasing(counts, size)
    if full:
        rows.append((size, 0, full, made, 1, 0))
    plan = spark.createDataFrame(rows, "length long, from_rank long, to_rank long, first_window long, per_window long, at long")

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_bucket.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.repartition(buckets, "bucket")
        .withColumn("rank", F.row_number().over(inside) - 1)
        .join(bases.hint("merge"), ["bucket", "length"])  # grows with the buckets: never broadcast
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    step = F.col("rank") - F.col("from_rank")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("from_rank"), F.col("to_rank") - 1)).select(
            "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
            (F.col("first_window") + F.floor(step / F.col("per_window"))).cast("long").alias("sequence_id"),
            (F.col("at") + step % F.col("per_window") * ranked["length"]).cast("long").alias("offset")
        )
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
