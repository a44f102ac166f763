"""Substring dedup by fixed-block anchors.

Every text's words fall into non-overlapping blocks of half the window, which are indexed. Every rolling run of a block's
length probes the index. A window that occurs in an earlier document holds one of that document's blocks whole, so it lies
around a hit. Each such window is dealt to one of its hits, that of the smallest hash; there what stands around the hit in all
texts is extended word by word, to the right and to the left, and texts part where their words differ. So a hit grows to the
maximal exact repeats that hold it, words are compared, not their hashes, and nothing pairs documents: of the texts that are
still together when a window is full, the smallest document counts.

What is indexed and probed lies in windows whose smallest run, which their content alone chooses, is in more than one text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom, contexts, copies
from weftline.llm.base import cut, trimmed
from weftline.llm.words import lowest, mixed, runs, stretches, sums, together


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


#: Bytes of texts that are looked at together.
AT_ONCE = 1 << 20


class _Texts:
    """Some texts, their words one after another; h: hashes of all runs of a block's length, of which those across two texts count for nothing."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.rows, self.window, self.block = rows, window, (window + 1) // 2
        words, self.counts = together([r[3] for r in rows])
        self.begins = np.cumsum(self.counts) - self.counts
        self.h = runs(sums(words), self.block)
        n = max(0, len(words) - window + 1)
        self.of = np.repeat(np.arange(len(rows)), self.counts)
        self.ids = np.array([r[0] for r in rows], np.int64)
        #: Windows that lie in one text.
        self.whole = np.arange(n) + window <= (self.begins + self.counts)[self.of[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows in one text: the windows, and the hash of each one's smallest run, mixed anew as small ones are alike."""
        at = lowest(self.h, self.window - self.block + 1)[self.whole]
        return np.flatnonzero(self.whole), mixed(self.h[at])

    def shared(self, near: bloom.Filter) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window may be in another text, and whether each run lies in such a window."""
        told = np.zeros(len(self.whole), bool)
        windows, chosen = self.anchors()
        told[windows] = near.test(chosen)
        before = np.append(0, np.cumsum(told))
        p = np.arange(len(self.h))
        return told, before[np.minimum(p + 1, len(told))] > before[np.clip(p - (self.window - self.block), 0, len(told))]

    def own(self) -> np.ndarray:
        """Whether each run is one of its text's blocks."""
        return (np.arange(len(self.h)) - self.begins[self.of[: len(self.h)]]) % self.block == 0


def _each(batches: Iterator[pa.RecordBatch], window: int, suspects) -> Iterator[_Texts]:
    """The different texts, some at a time."""
    held, size = [], 0
    for batch in copies.distinct(batches, suspects):
        for row in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "n", "text"))):
            if len(row[3]) < 2 * window - 1:
                continue
            held.append(row)
            size += len(row[3])
            if size >= AT_ONCE:
                yield _Texts(held, window)
                held, size = [], 0
    if held:
        yield _Texts(held, window)


def _chosen(window: int, suspects):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _each(batches, window, suspects):
            windows, h = t.anchors()
            of = t.of[windows]
            by = np.lexsort((h, of))
            h, of = h[by], of[by]
            # Once for each text that has it.
            yield pa.RecordBatch.from_arrays([_long(h[np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]])], names=["h"])

    return run


def _index(window: int, suspects, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = bloom.Filter(sent.value)
        for t in _each(batches, window, suspects):
            some = np.flatnonzero(t.shared(near)[1] & t.own())
            yield pa.RecordBatch.from_arrays([_long(t.h[some]), pa.array(t.ids[t.of[some]])], names=["h", "id"])

    return run


def _probe(window: int, suspects, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, once, again = (bloom.Filter(x) for x in sent.value)
        for t in _each(batches, window, suspects):
            some = np.flatnonzero(t.shared(near)[1])
            some = some[once.test(t.h[some])]
            # A text's own blocks are all there: they count where another block is the same.
            own = t.own()[some]
            keep = ~own
            keep[own] = again.test(t.h[some[own]])
            some = some[keep]
            # Of each run the largest document.
            h, ids = t.h[some], t.ids[t.of[some]]
            by = np.lexsort((ids, h))
            h, ids = h[by], ids[by]
            last = np.append(h[1:] != h[:-1], True)[: len(h)]
            yield pa.RecordBatch.from_arrays([_long(h[last]), pa.array(ids[last])], names=["h", "id"])

    return run


def _occurrences(window: int, suspects, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        near, shared = (bloom.Filter(x) for x in sent.value)
        for t in _each(batches, window, suspects):
            told, hit = t.shared(near)
            hit[hit] = shared.test(t.h[hit])
            if not hit.any():
                continue
            # Windows across two texts are none's, so a stretch stays within one.
            at = np.where(told, lowest(t.h, window - t.block + 1, hit), -1)
            last, words = -1, []
            for a, b in zip(*(x.tolist() for x in stretches(at))):
                k, p = int(t.of[a]), int(at[a])
                i, th, n, text = t.rows[k]
                if k != last:
                    last, words = k, text.split()
                first = int(t.begins[k])
                yield int(t.h[p].view(np.int64)), p - a, b" ".join(words[a - first : b - first + window]), i, th, p - first, max(1, n)

    return run


def _batched(make):
    """One Arrow batch for some hundred thousand rows, not one for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for out in make(batches):
            held.append(out)
            n += out.num_rows
            if n >= 200_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return trimmed(run)


def extended(rows: list[list], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of contexts.CLASS: whether the window that begins o words before the hit is in texts of different ids, and the smallest."""
    n, block = len(rows), (window + 1) // 2
    places = window - block + 1
    known: dict[bytes, int] = defaultdict(count().__next__)
    contents = [r[8].split(b" ") for r in rows]
    words = np.fromiter((known[w] for c in contents for w in c), np.int64, sum(map(len, contents)))
    size = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(size) - size
    before, low, high, least, most = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4, 5, 6))

    def further(label: np.ndarray, k: int) -> np.ndarray:
        """Labels parted by the word k places behind the hit's first one; behind the end of a context it is alone."""
        at = before + k
        there = (at >= 0) & (at < size)
        word = len(known) + np.arange(n)
        word[there] = words[begin[there] + at[there]]
        return np.unique(label * (len(known) + n) + word, return_inverse=True)[1]

    label = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    right, left = {}, [np.zeros(n, np.int64)]
    for k in range(window):
        label = further(label, k)
        right[k + 1] = label
    for k in range(1, places):
        left.append(further(left[-1], -k))
    told, value = np.zeros((n, places), bool), np.zeros((n, places), np.int64)
    for o in range(places):
        live = np.flatnonzero((before >= o) & (size - before >= window - o) & (low <= o) & (o < high))
        if len(live):
            pair, of = np.unique(right[window - o][live] * n + left[o][live], return_inverse=True)
            first, last = np.full(len(pair), np.iinfo(np.int64).max), np.full(len(pair), np.iinfo(np.int64).min)
            np.minimum.at(first, of, least[live])
            np.maximum.at(last, of, most[live])
            value[live, o] = first[of]
            told[live, o] = first[of] < most[live]
    return told, value


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n (words), spans (flat array of half-open word positions, maximal) and kept (the other words, UTF-8, one space between).

    A word goes if a run of `window` words of its text that covers it occurs in a text of smaller doc_id; runs are judged on the
    input. Words are separated by space and x09-x0D and not changed. Null texts have no words; a null doc_id is smaller than any
    other; rows with one doc_id don't remove from each other. Texts have less than 2**31 bytes. An empty table gives an empty
    one; other columns are ignored.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    rows = copies.keyed(docs)
    work, members, suspects = copies.set_apart(rows)
    send = lambda *tables: [bloom.build(x, x.count()).bits for x in tables]
    several = lambda table: cut(table.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    near = send(several(work.mapInArrow(_batched(_chosen(window, suspects)), "h long")))
    index = cut(work.mapInArrow(_batched(_index(window, suspects, spark.sparkContext.broadcast(near[0]))), "h long, id long"))
    sent = spark.sparkContext.broadcast([*near, *send(index.select("h"), several(index))])
    probes = work.mapInArrow(_batched(_probe(window, suspects, sent)), "h long, id long")
    first = index.groupBy("h").agg(F.min("id").alias("first"))
    # Each block needs its smallest document and the largest that probes it.
    shared = cut(probes.groupBy("h").agg(F.max("id").alias("last")).join(first, "h").filter("first < last").select("h"))
    hit = spark.sparkContext.broadcast([*near, *send(shared)])
    places, classes = contexts.gathered(work, _occurrences(window, suspects, hit), window - block + 1)
    found = contexts.settled(places, classes, lambda some: extended(some, window), window, window - block + 1, lambda content: content.split(b" "), b" ".join)
    spans = found.filter("least < id").select("id", "th", (F.col("at") - F.col("high") + 1).alias("first"), (F.col("at") - F.col("low") + window).alias("last"))
    # A copy of an earlier text goes whole if it has a window at all.
    counted = rows.join(members.filter("least < id").distinct(), ["id", "th"], "left_semi").select("id", "th", F.lit(0).alias("n"), "text")
    whole = counted.mapInArrow(_batched(_long_enough(window)), "id long, th long")
    return copies.carve(rows, spans, whole, bytes.split, lambda parts: b" ".join(w for p in parts for w in p))


def _long_enough(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(i, th) for i, th, text in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "text"))) if len(text.split()) >= window]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*keep)], names=["id", "th"])

    return run
