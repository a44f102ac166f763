"""Repeated byte strings by suffix sorting, deep and shallow.

Suffixes are sampled: each window of a text has an anchor, the 32 bytes in it with the smallest hash, the leftmost of equals. It
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets; consecutive windows mostly share
theirs. Suffixes that begin at anchors which occur more than once are sorted, each as far as its windows reach, with a weight for
those that are equal throughout; so is what lies before the anchors, read backwards. Both sorts are multikey quicksort to a
shallow depth, and then a blind trie for each group that still agrees. Two windows are equal if they agree far enough in both
orders, which the arrays of common prefixes tell: all removed spans, but for whole texts that have copies, are read from these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom, contexts, copies
from weftline.llm.base import cut, trimmed
from weftline.llm.words import lowest, mixed, runs, stretches, sums

GRAM = 32
#: Bytes to which multikey quicksort goes, eight a letter; bytes of texts hashed at once.
SHALLOW, AT_ONCE = 64, 1 << 20


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text that has a window, and each part of a long one: its index, where the part begins, and arrays of the
    anchors' hashes and positions and the first and last window of each, all within the part."""
    parts, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), AT_ONCE):
            part = text[at : at + AT_ONCE + length - 1]
            if len(part) >= length:
                parts.append((k, at, part))
                size += len(part)
            if size >= AT_ONCE:
                yield from _anchors(parts, length)
                parts, size = [], 0
    if parts:
        yield from _anchors(parts, length)


def _anchors(parts: list, length: int) -> Iterator:
    whole = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in parts])
    begins = ends - [len(p) for _, _, p in parts]
    h = runs(sums(whole.astype(np.uint64) + np.uint64(1)), GRAM)
    at = lowest(h, length - GRAM + 1)
    for (k, offset, part), a, b in zip(parts, begins.tolist(), ends.tolist()):
        own = at[a : b - length + 1]
        first, last = stretches(own)
        # Anchors have small hashes; mixed anew, they spread again.
        yield k, offset, mixed(h[own[first]]), own[first] - a, first, last


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings in a Patricia trie that knows only branching depths and bytes; a string is compared once, with the leaf that a
    blind descent reaches. Nodes: [depth, {byte or -1 at the end: child}], leaves: lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = (None, [k])
            return
        path, node = [], self.root
        while node[0] is not None:
            path.append(node)
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        n = common(s, other)
        if n == len(s) == len(other):
            node[1].append(k)
            return
        # The branch lies above the first node of the path that is deeper.
        above, below = None, node
        for x in path:
            if x[0] >= n:
                below = x
                break
            above = x
        leaf, mark = (None, [k]), s[n] if n < len(s) else -1
        if below[0] == n:
            below[1][mark] = leaf
            return
        new = (n, {mark: leaf, (other[n] if n < len(other) else -1): below})
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings in order, and the common prefix of each with the one before it, which is 0 for the first."""
        order: list[int] = []
        lcp: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            (depth, what), shared = stack.pop()
            if depth is None:
                order += what
                lcp += [shared] + [len(self.strings[what[0]])] * (len(what) - 1)
            else:
                keys = sorted(what, reverse=True)
                stack += [(what[c], shared if c == keys[-1] else depth) for c in keys]
        return order, lcp


def multikey(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of letters, a step of all groups at once: the order, and for each place in it where its group of equal rows begins.

    A group's rows are parted by their letter at the group's depth into those below a pivot, equal to it and above it; the equal
    ones go on at the next letter, the others at the same.
    """
    n, deepest = letters.shape
    order, start, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n) if n > 1 and deepest else np.zeros(0, np.int64)
    while len(live):
        group = start[live]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(live)))
        own = letters[order[live], depth[live]]
        a, b, c = own[first], own[first + size // 2], own[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        below, equal = own < pivot, own == pivot
        upto = [np.cumsum(x) - x for x in (below, equal, ~(below | equal))]
        rank = [x - np.repeat(x[first], size) for x in upto]
        many = [np.repeat(np.add.reduceat(x, first, dtype=np.int64), size) for x in (below, equal)]
        begin = group + np.where(below, 0, np.where(equal, many[0], many[0] + many[1]))
        to = begin + np.where(below, rank[0], np.where(equal, rank[1], rank[2]))
        order[to], start[to], depth[to] = order[live], begin, depth[live] + equal
        left = np.where(below, many[0], np.where(equal, many[1], np.repeat(size, size) - many[0] - many[1]))
        live = np.sort(to[(left > 1) & (depth[to] < deepest)])
    return order, start


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings and the common prefix of each with the one before it in order."""
    n = len(strings)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order, group = multikey(words)
    tied = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1) if n else order
    lcp = np.zeros(n, np.int64)
    lengths = np.array([len(s) for s in strings], np.int64)
    if n > 1:
        x = words[order[1:]] ^ words[order[:-1]]
        differs = x != 0
        word = np.where(differs.any(1), differs.argmax(1), SHALLOW // 8 - 1)
        left = x[np.arange(n - 1), word]
        bits = np.where(left > 0, np.floor(np.log2(np.maximum(left, 1).astype(np.float64))).astype(np.int64) + 1, 0)
        # log2 of a number just below a power of two may round up to it.
        bits -= (bits > 0) & (left >> np.minimum(np.maximum(bits - 1, 0), 63).astype(np.uint64) == 0)
        lcp[1:] = np.minimum(word * 8 + 8 - (bits + 7) // 8, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    # What still agrees goes to a blind trie.
    if len(tied):
        first = np.flatnonzero(np.append(True, group[tied][1:] != group[tied][:-1]))
        for a, b in zip(tied[first].tolist(), (tied[np.append(first[1:], len(tied)) - 1] + 1).tolist()):
            trie = BlindTrie(strings)
            for k in order[a:b].tolist():
                trie.add(k)
            sorted_, shared = trie.walk()
            order[a:b] = sorted_
            lcp[a + 1 : b] = shared[1:]
    return order, lcp


def repeated(rows: list[list], length: int) -> tuple[np.ndarray, None]:
    """Rows of contexts.CLASS: true at o if the window that begins o bytes before the anchor is there more than once, in one class or in two."""
    n = len(rows)
    places = length - GRAM + 1
    before, low, high, weight = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4, 7))
    out = np.zeros((n, places), bool)
    right, rp = deep_shallow([r[8][r[2] :] for r in rows])
    left, lp = deep_shallow([r[8][: r[2]][::-1] for r in rows])
    after = np.array([len(r[8]) for r in rows], np.int64) - before
    label_r, label_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(places):
        live = np.flatnonzero((before >= o) & (after >= length - o) & (low <= o) & (o < high))
        if not len(live):
            continue
        label_r[right] = np.cumsum(rp < length - o)
        label_l[left] = np.cumsum(lp < o)
        pair = label_r[live] * (n + 1) + label_l[live]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        out[live[by[np.append(same, False) | np.append(False, same) | (weight[live[by]] > 1)]], o] = True
    return out, None


def _hashes(length: int, suspects):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in copies.distinct(batches, suspects):
            found = [h for _, _, h, *_ in anchors(batch.column("text").to_pylist(), length)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["ah"])

    return run


def _occurrences(length: int, suspects, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        again = bloom.Filter(sent.value)
        for some in copies.distinct(batches, suspects):
            ids, ths, ns, texts = (some.column(c).to_pylist() for c in ("id", "th", "n", "text"))
            for t, offset, h, at, first, last in anchors(texts, length):
                hit = np.flatnonzero(again.test(h))
                for ah, p, a, b in zip(h[hit].view(np.int64).tolist(), at[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    yield ah, p - a, texts[t][offset + a : offset + b + length], ids[t], ths[t], offset + p, max(1, ns[t])

    return run


def repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n (bytes), spans (flat array of half-open byte positions, maximal) and kept (the other bytes).

    A byte goes if a string of `length` bytes of its text that covers it begins anywhere else too, in the same text or another;
    strings are judged on the input and never cross texts, which have less than 2**31 bytes. Null texts are empty. Rows that
    repeat a doc_id are texts like any other, and so repeat each other; null doc_ids stay null. An empty table gives an empty
    one; other columns are ignored.
    """
    if length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes or more")
    spark, places = docs.sparkSession, length - GRAM + 1
    rows = copies.keyed(docs)
    work, members, suspects = copies.set_apart(rows)
    hashes = work.mapInArrow(trimmed(_hashes(length, suspects)), "ah long")
    again = cut(hashes.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ah"))
    sent = spark.sparkContext.broadcast(bloom.build(again, again.count()).bits)
    places_of, classes = contexts.gathered(work, _occurrences(length, suspects, sent), places)
    found = contexts.settled(places_of, classes, lambda some: repeated(some, length), length, places, lambda content: content, lambda units: units)
    spans = found.select("id", "th", (F.col("at") - F.col("high") + 1).alias("first"), (F.col("at") - F.col("low") + length).alias("last"))
    # Every copy of a text that has a window goes whole.
    whole = members.join(rows.filter(F.octet_length("text") >= length).select("id", "th"), ["id", "th"], "left_semi").select("id", "th").distinct()
    return copies.carve(rows, spans, whole, lambda text: text, b"".join)
