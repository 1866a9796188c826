"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A span of ``length`` and more consecutive words that also stands in a document with a smaller doc_id is removed. Every
document is both reference and stream, so automata of the whole corpus can't be broadcast to every task. Instead texts
are dealt out so that all that can match meets in one shard:

1. Each window of ``length`` words has an anchor: the least hash among its ``ANCHOR``-word runs. Consecutive windows with
   the same anchor form a segment of some 17 words; equal windows have equal anchors, so their segments go to the same
   shard, whatever stands around them. A batch of documents sends each shard one compressed block of its distinct segments
   with the least doc_id of each, however many of its documents have them.
2. In a shard, the distinct segments of an anchor that more than one document has are its reference. A suffix automaton
   over them (inserted by rising doc_id, so that each state knows the first document with its substrings) is read by the
   segments: the matching statistic at a word is the length of the longest suffix found, and where it reaches ``length``
   the state's first document is looked up. A block is answered with the first documents of its segments' windows.
3. Answers go back to their batch, where every document drops the maximal spans of windows that a smaller doc_id owns.

A passage that many documents share is one segment a batch, not one a document. Work and blocks grow with the corpus, not
with pairs of documents or of shards. Shards are as many as the shuffle's partitions, or one for each 4 MB of the table's
files if these are more; each is read by itself.

Null text: no words. A null doc_id is neither smaller nor larger than another: such rows keep all words and remove none.
Rows of one doc_id don't remove each other's words; repeated rows are ties and keep alike. Texts shorter than ``length``
words and empty tables work as expected; very long texts are read whole (a batch holds at least one). Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.pywords import mixed, record_batch, rows, window_hashes, word_hashes
from spanloom.llm.scratch import shards_for

LENGTH, ANCHOR, RUN, BATCH_CHARS = 13, 4, 32, 10_000_000
SCHEMA = "shard int, batch string, kind int, data binary, ids array<long>"
NAMES, TYPES = ["shard", "batch", "kind", "data", "ids"], [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
#: Kinds of blocks: a batch's words; its segments for a shard; the shard's answer.
WORDS, SEGMENTS, OWNERS = range(3)


def segments(h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows (at most RUN) of each segment of a text with word hashes ``h``."""
    a = window_hashes(h, anchor)
    least, reach = a, 1
    need = length - anchor + 1
    while reach * 2 <= need:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < need:
        least = np.minimum(least[: len(least) - (need - reach)], least[need - reach :])
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], change])
    counts = np.diff(np.concatenate([starts, [len(least)]]))
    if counts.max() > RUN:
        parts = -(-counts // RUN)
        first = np.repeat(starts, parts)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, counts = first + nth * RUN, np.minimum(RUN, np.repeat(counts, parts) - nth * RUN)
    return least[starts], starts, counts


class Cut:
    """The segments of a batch: the distinct ones, dealt to shards, and each place where one stands."""

    def __init__(self, lines: list[bytes], ids: list[int | None], length: int, anchor: int, shards: int):
        keys, starts, counts, docs, pieces = [], [], [], [], []
        for i, line in enumerate(lines):
            w = line.split()
            if ids[i] is None or len(w) < length:
                continue
            key, start, count = segments(word_hashes(w), length, anchor)
            sizes = np.fromiter(map(len, w), np.int64, len(w))
            ends = np.cumsum(sizes + 1) - 1
            begin, end = (ends - sizes)[start].tolist(), ends[start + count + length - 2].tolist()
            pieces += [line[a:b] for a, b in zip(begin, end, strict=True)]
            keys.append(key)
            starts.append(start)
            counts.append(count)
            docs.append(np.full(len(key), i))
        none = [np.empty(0, np.int64)]
        key = np.concatenate(keys or [np.empty(0, np.uint64)])
        self.start, self.count, self.doc = (np.concatenate(x or none) for x in (starts, counts, docs))
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        first = np.zeros(len(number), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, np.array([0 if d is None else d for d in ids], np.int64)[self.doc])
        anchors = key[first]
        # in a block an anchor is 32 bits long: two that fall together only put more texts into one automaton
        self.key = (anchors >> np.uint64(32)).astype("<u4")
        shard = (mixed(anchors) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((first, self.key, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which, self.owner, self.key = place[which], owner[order], self.key[order]
        self.ends = np.searchsorted(shard[order], np.arange(shards + 1))
        texts = list(number)
        self.texts = [texts[i] for i in order.tolist()]


def send(shards: int, length: int, anchor: int, batch_chars: int):
    """(doc_id, text) to a batch's block of words and its blocks of distinct segments."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, lines, ids, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            batch = f"{task}-{number}"
            own = zlib.crc32(batch.encode()) % shards
            yield record_batch(NAMES, TYPES, [(own, batch, WORDS, zstandard.ZstdCompressor(9).compress(b"\n".join(lines)), ids)])
            cut, packer = Cut(lines, ids, length, anchor, shards), zstandard.ZstdCompressor(6)
            for s in range(shards):
                a, b = cut.ends[s : s + 2].tolist()
                if a < b:
                    head = np.array([b - a], "<u4").tobytes() + cut.key[a:b].tobytes() + cut.owner[a:b].astype("<i8").tobytes()
                    yield record_batch(NAMES, TYPES, [(s, batch, SEGMENTS, packer.compress(head + b"\n".join(cut.texts[a:b])), None)])

        for doc_id, text in rows(batches):
            line = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
            lines.append(line)
            ids.append(doc_id)
            chars += len(line)
            if chars >= batch_chars:
                yield from flush()
                number, lines, ids, chars = number + 1, [], [], 0
        if lines:
            yield from flush()

    return run


class SuffixAutomaton:
    """Of several word sequences; each state knows the owner of its first sequence. Insert by rising owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.owner = [-1], [0], [None]

    def _state(self, size: int, owner, arcs: dict, link: int) -> int:
        self.next.append(arcs)
        self.len.append(size)
        self.owner.append(owner)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.owner[q], self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def insert(self, sequence: list[bytes], owner) -> None:
        last, nexts, link, size = 0, self.next, self.link, self.len
        for word in sequence:
            q = nexts[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(size[last] + 1, owner, {}, 0)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
            last = new

    def first_owners(self, sequence: list[bytes], length: int) -> list:
        """For each word from the ``length``-th on, the first owner of the ``length`` words that end there (None: not found)."""
        state, matched, out = 0, 0, []
        nexts, link, size = self.next, self.link, self.len
        for i, word in enumerate(sequence):
            while state and word not in nexts[state]:
                state = link[state]
                matched = size[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            while matched >= length and size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            if i >= length - 1:
                out.append(self.owner[state] if matched >= length else None)
        return out


def match(length: int):
    """A shard's blocks to the first documents of their segments' windows. Words pass.

    An answer lists the segments that have another first document than the block's own least one: their numbers in the
    block, the number of documents given for each (one for all windows, or one for each), and the documents.
    """

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        out: list[tuple] = []
        batches, keys, owners, texts = [], [], [], []
        shard = 0
        for shard, batch, kind, data, ids in rows(iter(table.to_batches())):
            if kind == WORDS:
                out.append((shard, batch, kind, data, ids))
                continue
            data = zstandard.ZstdDecompressor().decompress(data)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            batches.append(batch)
            keys.append(np.frombuffer(data, "<u4", n, 4))
            owners.append(np.frombuffer(data, "<i8", n, 4 + 4 * n))
            texts.append((data, 4 + 12 * n))
        if not batches:
            return pa.Table.from_batches([record_batch(NAMES, TYPES, out)])
        sizes = np.array([len(k) for k in keys])
        base = np.concatenate([[0], np.cumsum(sizes)])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        groups = np.flatnonzero(np.minimum.reduceat(owner[order], edges[:-1]) != np.maximum.reduceat(owner[order], edges[:-1]))

        within = np.zeros(len(key) + 1, np.int64)
        np.add.at(within, edges[groups], 1)
        np.add.at(within, edges[groups + 1], -1)
        wanted = np.zeros(len(key), bool)
        wanted[order[np.cumsum(within[:-1]) > 0]] = True
        text: dict[int, bytes] = {}
        for (data, at), a, b in zip(texts, base[:-1].tolist(), base[1:].tolist(), strict=True):
            some = np.flatnonzero(wanted[a:b])
            if len(some):
                breaks = np.flatnonzero(np.frombuffer(data, np.uint8, offset=at) == 10) + at
                begin, end = np.concatenate([[at], breaks + 1]), np.concatenate([breaks, [len(data)]])
                for i, x, y in zip((some + a).tolist(), begin[some].tolist(), end[some].tolist(), strict=True):
                    text[i] = data[x:y]
        texts.clear()

        found: dict[int, list[int]] = {}
        for a, b in zip(edges[groups].tolist(), edges[groups + 1].tolist(), strict=True):
            by_text: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                by_text.setdefault(text[i], []).append(i)
            owned = sorted((int(owner[at].min()), t) for t, at in by_text.items())
            automaton = None
            if len(owned) > 1:  # one sequence is its own automaton: every window's first owner is the sequence's
                automaton = SuffixAutomaton()
                for first, t in owned:
                    automaton.insert(t.split(), first)
            for first, t in owned:
                firsts = {first} if automaton is None else automaton.first_owners(t.split(), length)
                same = len(set(firsts)) == 1
                for i in by_text[t]:
                    if not same or owner[i] not in firsts:
                        found[i] = list(firsts)[:1] if same else firsts

        at = np.array(sorted(found), np.int64)
        cuts = np.searchsorted(at, base)
        packer = zstandard.ZstdCompressor(3)
        for batch, start, a, b in zip(batches, base[:-1].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = [found[i] for i in at[a:b].tolist()]
            if mine:
                parts = (np.array([len(mine)], "<u4"), (at[a:b] - start).astype("<u4"), np.array([len(m) for m in mine], "u1"), np.array([f for m in mine for f in m], "<i8"))
                out.append((shard, batch, OWNERS, packer.compress(b"".join(p.tobytes() for p in parts)), None))
        return pa.Table.from_batches([record_batch(NAMES, TYPES, out)])

    return run


def finish(length: int, anchor: int, shards: int, texts: bool):
    """A batch's words and answers to what is left of each text."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        all_rows = list(rows(iter(table.to_batches())))
        ids, packed = next((r[4], r[3]) for r in all_rows if r[2] == WORDS)
        lines = zstandard.ZstdDecompressor().decompress(packed).split(b"\n")
        cut = Cut(lines, ids, length, anchor, shards)
        cut.texts.clear()
        owner, several = cut.owner.copy(), {}
        for shard, _, kind, data, _ in all_rows:
            if kind != OWNERS:
                continue
            data = zstandard.ZstdDecompressor().decompress(data)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            at = np.frombuffer(data, "<u4", n, 4).astype(np.int64) + cut.ends[shard]
            given = np.frombuffer(data, "u1", n, 4 + 4 * n).astype(np.int64)
            firsts = np.frombuffer(data, "<i8", int(given.sum()), 4 + 5 * n)
            begin = np.cumsum(given) - given
            one = given == 1
            owner[at[one]] = firsts[begin[one]]
            several |= {int(e): firsts[x : x + g] for e, x, g in zip(at[~one].tolist(), begin[~one].tolist(), given[~one].tolist(), strict=True)}
        of_several = np.zeros(len(owner), bool)
        of_several[list(several)] = True
        edges = np.searchsorted(cut.doc, np.arange(len(lines) + 1))

        out: list[tuple] = []
        for i, line in enumerate(lines):
            w = line.split()
            a, b = edges[i : i + 2].tolist()
            spans: list[tuple[int, int]] = []
            kept = w
            if a < b:
                e, start, count = cut.which[a:b], cut.start[a:b], cut.count[a:b]
                hit = (owner[e] < ids[i]) & ~of_several[e]
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, start[hit], 1)
                np.add.at(change, (start + count + length - 1)[hit], -1)
                for k in np.flatnonzero(of_several[e]).tolist():
                    windows = start[k] + np.flatnonzero(several[int(e[k])] < ids[i])
                    np.add.at(change, windows, 1)
                    np.add.at(change, windows + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                kept = [w[j] for j in np.flatnonzero(~gone).tolist()] if spans else w
            left = b" ".join(kept)
            flat = [x for s in spans for x in s]
            out.append((ids[i], len(w), len(w) - len(kept), hashlib.sha256(left).hexdigest(), flat, left.decode("utf-8", "surrogatepass") if texts else None))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
        return pa.Table.from_batches([record_batch(names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()], out)])

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, texts: bool = True, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start, end, start, end ... of the removed words), kept (with ``texts``)."""
    shards, anchor = shards_for(docs, 4 << 20), min(anchor, length)
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = rows_.mapInArrow(send(shards, length, anchor, batch_chars), SCHEMA)
    answered = blocks.groupBy("shard").applyInArrow(match(length), SCHEMA)
    out = answered.groupBy("batch").applyInArrow(finish(length, anchor, shards, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, kept string")
    return out if texts else out.drop("kept")


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
