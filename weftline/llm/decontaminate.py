"""Benchmark decontamination: n-grams of the test items seed passages, Smith-Waterman alignment scores them.

Words are compared without case and without punctuation at their ends. Every n-gram of an item is a seed, however many documents
hold it: counts would include the contaminated ones. Documents and seeds join on the n-gram; a seed's place in the document less
that in the item gives a diagonal, and close diagonals a passage. A passage that has enough of the item's words to reach the
threshold is aligned word by word with its item: two for a match, one off for another word or a gap. The score is the best local
alignment's, as a share of what the whole item would have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom, copies
from weftline.llm.base import OWN, claim, cut, sliced, trimmed
from weftline.llm.words import runs, sums

#: Words of a seed; score from which a document holds an item; what diagonals of one passage differ by at most.
SEED, THRESHOLD, BAND = 3, 0.5, 32
#: Cells of alignments at once; words of all items that are sent to the executors at most, 32 MB.
CELLS, SENT = 4_000_000, 4_000_000
_STRIP = ".,;:!?\"'()[]{}<>|/\\-_*#$%&+=~`“”‘’«»…"


class _Plain(dict):
    """The hash of a word without case and outer punctuation; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        plain = word.decode("utf-8", "replace").strip(_STRIP).casefold()
        value = self[word] = xxhash.xxh64_intdigest(plain) | 1 if plain else 0
        return value


_plain = _Plain()


def plain(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that have letters, digits or inner signs, and the number of each among all words."""
    claim("plain words", _plain.clear)
    words = text.split()
    h = np.fromiter(map(_plain.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(h)
    return h[at], at


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignments of items (k, n) and passages (k, m) of word hashes, 0 for no word: scores, and where in the passage they end.

    Rows of the matrix go over the item; a gap within a row is the running maximum of scores plus their columns.
    """
    k, m = passages.shape
    best, end = np.zeros(k, np.int32), np.zeros(k, np.int32)
    above = np.zeros((k, m + 1), np.int32)
    column = np.arange(m + 1, dtype=np.int32)
    for j in range(items.shape[1]):
        word = items[:, j, None]
        row = np.zeros((k, m + 1), np.int32)
        row[:, 1:] = above[:, :-1] + np.where((passages == word) & (word != 0), 2, -1)
        np.maximum(row, above - 1, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + column, axis=1) - column
        row[items[:, j] == 0] = 0
        top = row.argmax(1)
        value = row[np.arange(k), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = row
    return best, end


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.uint64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def scored(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int, int]]:
    """For each item and passage: the score, and the first and last word, half-open, of the aligned part of the passage."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        some, cells = [], 0
        while order and (not some or cells * (len(some) + 1) <= CELLS):
            some.append(order.pop())
            cells = max(cells, len(pairs[some[-1]][1]) + 1)
        items, passages = [pairs[k][0] for k in some], [pairs[k][1] for k in some]
        best, end = align(_padded(items), _padded(passages))
        # The same alignment backwards, from its end, tells where it begins.
        _, back = align(_padded([x[::-1] for x in items]), _padded([p[:e][::-1] for p, e in zip(passages, end)]) if end.any() else np.zeros((len(some), 1), np.uint64))
        for k, item, b, e, s in zip(some, items, best.tolist(), end.tolist(), back.tolist()):
            out[k] = b / (2 * len(item)), e - s, e
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [plain(text)[0].view(np.int64) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.list_(pa.int64()))], names=["item", "words"])


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            for item, key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                g = runs(sums(words.values.to_numpy().view(np.uint64)), n)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), item)), pa.array(np.full(len(g), key)), pa.array(np.arange(len(g), dtype=np.int32))], names=["g", "item", "key", "pos"])

    return run


def _found(n: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Filter(sent.value)
        for batch in sliced(batches):
            out: tuple[list, list, list, list] = [], [], [], []
            for i, th, text in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "text"))):
                g = runs(sums(plain(text)[0]), n)
                at = np.flatnonzero(known.test(g))
                for part, x in zip(out, (g[at].view(np.int64), np.full(len(at), i), np.full(len(at), th), at.astype(np.int32))):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["g", "id", "th", "pos"])

    return run


class _Best:
    """Passages to align, so many at a time, and the best one of each document and item that reaches the threshold."""

    def __init__(self, threshold: float, pad: int) -> None:
        self.threshold, self.pad = threshold, pad
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys: list[tuple] = []
        self.rows: dict[tuple, tuple] = {}
        self.held = 0

    def add(self, doc: int, h: np.ndarray, at: np.ndarray, passages: Iterator[tuple]) -> None:
        """A document's words and their numbers, and its passages (item, the item's words, low, high)."""
        for item, words, low, high in passages:
            first = max(0, low - self.pad - len(words) // 2)
            passage = h[first : high + len(words) + self.pad + len(words) // 2]
            # No alignment matches more words than occur.
            if np.isin(words, passage).mean() >= self.threshold:
                self.keys.append((doc, item, first, at))
                self.pairs.append((words, passage))
                self.held += len(passage) + len(at)
        if self.held > CELLS:
            self.done()

    def done(self) -> None:
        for (doc, item, first, at), (score, a, b) in zip(self.keys, scored(self.pairs)):
            if score >= self.threshold and score > self.rows.get((doc, item), (0,))[0]:
                self.rows[doc, item] = score, int(at[first + a]), int(at[first + b - 1]) + 1
        self.keys, self.pairs, self.held = [], [], 0

    def batch(self) -> pa.RecordBatch:
        self.done()
        rows, self.rows = self.rows, {}
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.int64())] + [pa.array([r[j] for r in rows.values()], t) for j, t in enumerate((pa.float64(), pa.int32(), pa.int32()))], names=["id", "item", "score", "first_word", "last_word"])


def _verify(threshold: float, pad: int):
    """Rows (id, text, passages of (item, key, low, high), words of the only one): those whose best passage of an item reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(threshold, pad)
        for batch in sliced(batches, 200):
            for i, text, passages, words in zip(*(x.to_pylist() for x in batch.columns[:3]), batch.column(3)):
                item = words.values.to_numpy().view(np.uint64)
                best.add(i, *plain(text), ((p["item"], item, p["low"], p["high"]) for p in passages))
            yield best.batch()

    return run


def _sought(n: int, threshold: float, pad: int, seeds, sent):
    """Rows (id, th, text) against the items sent, (item, words) each: seeds, passages and alignments in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told, best = bloom.Filter(seeds.value), sent.value, _Best(threshold, pad)
        g = [runs(sums(words), n) for _, words in told]
        of, own, g = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g]), np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in g)]), np.concatenate([np.zeros(0, np.uint64), *g])
        by = np.argsort(g, kind="stable")
        g, of, own = g[by], of[by], own[by]
        for batch in sliced(batches, 200):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h, at = plain(text)
                probes = runs(sums(h), n)
                pos = np.flatnonzero(known.test(probes))
                if len(pos):
                    begin = np.searchsorted(g, probes[pos], "left")
                    count = np.searchsorted(g, probes[pos], "right") - begin
                    hit = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                    if len(hit):
                        best.add(i, h, at, passages(told, of[hit], np.repeat(pos, count) - own[hit]))
            yield best.batch()

    def passages(told: list, of: np.ndarray, low: np.ndarray) -> Iterator[tuple]:
        """Close diagonals of an item, by bands, from the lowest to the highest."""
        band = np.floor_divide(low, BAND)
        by = np.lexsort((low, band, of))
        of, low, band = of[by], low[by], band[by]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (band[1:] != band[:-1])))
        for a, b in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(of) - 1]):
            yield *told[of[a]], int(low[a]), int(low[b])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, score (threshold to 1), first_word and last_word of the passage (half-open, words by white space).

    An item of fewer words than a seed has none and is never found; in scripts without spaces a whole sentence is one word. Null
    texts are empty; a null item_id or doc_id is kept as it is; rows that share an id with different texts are searched apart,
    and equal rows give one row. With an empty table of either kind there are no rows; other columns are ignored. Memory grows
    with the largest text and item: all items' words are sent if they are at most SENT, and documents are searched in one pass;
    else seeds and words are joined.
    """
    spark = docs.sparkSession
    rows = copies.keyed(docs)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(copies.NO_ID)).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    told = items.mapInArrow(trimmed(_words), "item long, words array<long>").filter(F.size("words") >= seed)
    told = cut(told.select("item", F.xxhash64("words").alias("key"), "words"))
    grams = cut(told.mapInArrow(trimmed(_grams(seed)), "g long, item long, key long, pos int"))
    # Four times the room of other filters: few words that are no seeds get through.
    sent = spark.sparkContext.broadcast(bloom.build(grams.select("g"), 4 * grams.count()).bits)
    schema = "id long, item long, score double, first_word int, last_word int"
    if (told.agg(F.sum(F.size("words"))).first()[0] or 0) <= SENT:
        known = spark.sparkContext.broadcast([(r.item, np.array(r.words, np.int64).view(np.uint64)) for r in told.collect()])
        out = rows.mapInArrow(trimmed(_sought(seed, threshold, BAND // 2, sent, known)), schema)
    else:
        found = cut(rows.mapInArrow(trimmed(_found(seed, sent)), "g long, id long, th long, pos int"))
        hits = found.join(grams.withColumnRenamed("pos", "own"), "g").withColumn("low", F.col("pos") - F.col("own"))
        # Passages of neighbouring bands overlap by what each is widened.
        passages = hits.groupBy("id", "th", "item", "key", F.floor(F.col("low") / BAND).alias("band")).agg(F.min("low").alias("low"), F.max("low").alias("high"))
        asked = cut(passages.select("id", "th", F.array(F.struct("item", "key", "low", "high")).alias("passages"), "item", "key"))
        # Only documents with passages move.
        flagged = copies.member(spark, bloom.build(asked.select("th"), asked.count()))
        texts = rows.filter(flagged("th")).dropDuplicates(["id", "th"])
        both = texts.join(asked, ["id", "th"]).join(told, ["item", "key"]).select("id", "text", "passages", "words")
        out = both.mapInArrow(trimmed(_verify(threshold, BAND // 2)), schema)
    best = out.groupBy("id", "item").agg(F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("best"))
    return best.select(F.nullif("id", F.lit(copies.NO_ID)).alias("doc_id"), F.nullif("item", F.lit(copies.NO_ID)).alias("item_id"), "best.score", (-F.col("best.col2")).alias("first_word"), "best.last_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no item, with all their columns; rows of one doc_id stay or go together."""
    bad = leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(copies.NO_ID)).alias(OWN)).distinct()
    return docs.join(cut(bad), F.coalesce(F.col("doc_id").cast("long"), F.lit(copies.NO_ID)) == F.col(OWN), "left_anti")
