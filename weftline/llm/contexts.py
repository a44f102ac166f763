"""Anchors and their contexts: how windows that share one meet, without pairs and in bounded groups.

A window of `length` units (bytes, or words) has one anchor of `core` units, which its content alone chooses. Successive windows
of a text mostly share theirs; what these windows cover is the anchor's context there. An occurrence is a member of the class of
its context; a class goes to its anchor's task once for each task that met it, with its content and what is known of its
members. There the classes are held against each other, by content; what comes out for a class holds for all its members.

Anchors of very many classes are halved by the windows' offsets: the windows of either half share more units, which join the
anchor in its key, and keep less of the content, so classes fall together; again, until no anchor has too many. At the end of
that, one offset, a key is a whole window. So no task ever holds more than LIMIT classes of one anchor that differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.base import cut, joined, trimmed

#: Classes of one anchor from which it is halved; bytes of classes held before they are sent, and of contexts looked at together.
LIMIT, HELD, SORTED = 2_000, 6_000_000, 8_000_000
#: A member has cls, id, th and at; a class the others, id to most of its members' ids, n of them; low and high: its offsets, half-open.
_CLASS = [("ah", pa.int64()), ("cls", pa.binary()), ("before", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("n", pa.int64()), ("content", pa.binary())]
_MEMBER = [("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32())]
CLASS = "ah long, cls binary, before int, low int, high int, least long, most long, n long, content binary"
TABLE = CLASS + ", id long, th long, at int"
RESULT = "cls binary, low int, high int, least long, n long"


class Classes:
    """Classes that a task has met, combined, until they are sent."""

    def __init__(self) -> None:
        self.held: dict[bytes, list] = {}
        self.size = 0

    def add(self, ah: int, before: int, low: int, high: int, least: int, most: int, n: int, content: bytes) -> bytes:
        """The class of a context; content: `before` units and those from the anchor on, for windows that begin low to high - 1 units before it."""
        cls = xxhash.xxh3_128_digest(content, (before << 40) ^ (low << 20) ^ high)
        if known := self.held.get(cls):
            known[5], known[6], known[7] = min(known[5], least), max(known[6], most), known[7] + n
        else:
            self.held[cls] = [ah, cls, before, low, high, least, most, n, content]
            self.size += len(content) + 300
        return cls

    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> list[list]:
        out = list(self.held.values())
        self.held, self.size = {}, 0
        return out


def _batch(classes: list[list], members: list[tuple]) -> pa.RecordBatch:
    """Both kinds of rows of TABLE."""
    of = list(zip(*classes)) or [()] * len(_CLASS)
    told = list(zip(*members)) or [()] * 4
    arrays = []
    for k, (name, kind) in enumerate(_CLASS):
        own = pa.array(of[k], kind)
        arrays.append(pa.concat_arrays([own, pa.array(told[0], kind) if name == "cls" else pa.nulls(len(members), kind)]))
    arrays += [pa.concat_arrays([pa.nulls(len(classes), kind), pa.array(told[k + 1], kind)]) for k, (_, kind) in enumerate(_MEMBER)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _CLASS + _MEMBER])


def gathered(rows: DataFrame, occurrences: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], places: int) -> tuple[DataFrame, DataFrame]:
    """Members (cls, id, th, at) and classes (CLASS) of what occurrences() finds in batches: (ah, before, content, id, th, at, n), at: the anchor's place; n: rows that have the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, members = Classes(), []
        for ah, before, content, i, th, at, n in occurrences(batches):
            members.append((classes.add(ah, before, 0, places, i, i, n, content), i, th, at))
            if classes.full() or len(members) >= 50_000:
                yield _batch(classes.take() if classes.full() else [], members)
                members = []
        yield _batch(classes.take(), members)

    table = cut(rows.mapInArrow(trimmed(run), TABLE))
    return table.filter("content is null").select("cls", "id", "th", "at"), table.filter("content is not null").select(*[n for n, _ in _CLASS])


def _halves(length: int, split: Callable, join: Callable):
    """Class rows as rows of either half of their offsets that they have windows in, and the class that each comes from as a member (cls, id: none, th: none, at: none) with `of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, links = Classes(), []
        for batch in batches:
            for ah, cls, before, low, high, least, most, n, content in zip(*(x.to_pylist() for x in batch.columns)):
                units = split(content)
                after = len(units) - before
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid, high)):
                    if max(a, length - after) > min(before, b - 1):
                        continue
                    left = min(before, b - 1)
                    shared = join(units[before - a : before + length - (b - 1)])
                    key = xxhash.xxh3_64_intdigest(shared, (ah & (1 << 62) - 1) ^ (a << 20) ^ b)
                    part = join(units[before - left : before + min(after, length - a)])
                    new = classes.add(key - (1 << 64) if key >> 63 else key, left, a, b, least, most, n, part)
                    links.append((new, cls))
            if classes.full() or len(links) >= 50_000:
                yield out(classes.take(), links)
                links = []
        yield out(classes.take(), links)

    def out(classes: list[list], links: list[tuple]) -> pa.RecordBatch:
        of = list(zip(*classes)) or [()] * len(_CLASS)
        new, old = list(zip(*links)) or ((), ())
        arrays = [pa.concat_arrays([pa.array(of[k], kind), pa.array(new, kind) if name == "cls" else pa.nulls(len(links), kind)]) for k, (name, kind) in enumerate(_CLASS)]
        return pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays([pa.nulls(len(classes), pa.binary()), pa.array(old, pa.binary())])], names=[*(n for n, _ in _CLASS), "of"])

    return run


def _judged(judge: Callable, places: int):
    """Class rows sorted by anchor: for each class the runs of offsets that judge(classes) tells of, a batch of whole anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size, last = 0, None
        for batch in batches:
            for ah, cls, before, low, high, least, most, n, content in zip(*(x.to_pylist() for x in batch.columns)):
                if ah != last and size >= SORTED:
                    yield done(list(held.values()))
                    held, size = {}, 0
                last = ah
                if known := held.get((ah, cls)):
                    known[5], known[6], known[7] = min(known[5], least), max(known[6], most), known[7] + n
                else:
                    held[ah, cls] = [ah, cls, before, low, high, least, most, n, content]
                    size += len(content)
        if held:
            yield done(list(held.values()))

    def done(rows: list[list]) -> pa.RecordBatch:
        ah = np.array([r[0] for r in rows], np.int64)
        n = np.array([r[7] for r in rows], np.int64)
        # Anchors of one row have nothing to be held against.
        alone = np.flatnonzero(np.append(True, ah[1:] != ah[:-1]) & np.append(ah[1:] != ah[:-1], True) & (n < 2)) if len(ah) else []
        keep = np.ones(len(rows), bool)
        keep[alone] = False
        rows = [r for r, k in zip(rows, keep.tolist()) if k]
        told, value = judge(rows) if rows else (np.zeros((0, places), bool), None)
        # Runs of offsets with one value.
        change = np.ones((len(rows), places + 1), bool)
        change[:, 1:-1] = told[:, 1:] != told[:, :-1]
        if value is not None:
            change[:, 1:-1] |= value[:, 1:] != value[:, :-1]
        row, begin = np.nonzero(change[:, :-1] & told)
        _, end = np.nonzero(change[:, 1:] & told)
        least = pa.nulls(len(row), pa.int64()) if value is None else pa.array(value[row, begin])
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in row.tolist()], pa.binary()), pa.array(begin.astype(np.int32)), pa.array((end + 1).astype(np.int32)), least, pa.array([rows[k][7] for k in row.tolist()], pa.int64())], names=["cls", "low", "high", "least", "n"])

    return run


def settled(members: DataFrame, classes: DataFrame, judge: Callable[[list[list]], tuple[np.ndarray, np.ndarray | None]], length: int, places: int, split: Callable, join: Callable) -> DataFrame:
    """id, th, at, low, high and least: for each member the runs of offsets that judge() tells of its class, and the value told.

    judge(rows of CLASS, whole anchors) gives for each row and offset whether it tells, never where the class has no window, and
    what, if it tells more than that. split(content) and join(units) tell the units of a context.
    """
    names = [n for n, _ in _CLASS]
    ready, links = [], []
    while True:
        wide = classes.filter("high - low > 1")
        hot = cut(wide.groupBy("ah").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > LIMIT).select("ah"))
        if hot.isEmpty():
            break
        # A round reads what the last one wrote, and only that: what is not halved goes to the judges as it is.
        ready += [classes.filter("high - low <= 1").select(*names), wide.join(hot, "ah", "left_anti").select(*names)]
        # Adaptive execution sends the list to all if it is small, and else splits what is skewed.
        halves = cut(wide.join(hot, "ah", "left_semi").select(*names).mapInArrow(trimmed(_halves(length, split, join)), CLASS + ", of binary"))
        new = halves.filter("of is not null").select("cls", "of")
        if links:
            new = new.withColumnRenamed("of", "mid").join(links[-1].withColumnRenamed("cls", "mid"), "mid").select("cls", "of")
        links.append(cut(new.distinct()))
        classes = halves.filter("of is null").select(*names)
    classes = reduce(DataFrame.unionByName, [*ready, classes])
    found = cut(classes.repartition("ah").sortWithinPartitions("ah").mapInArrow(trimmed(_judged(judge, places)), RESULT))
    if links:
        found = cut(found.unionByName(found.join(reduce(DataFrame.unionByName, links), "cls").drop("cls").withColumnRenamed("of", "cls").select(*found.columns)))
    return joined(members, found, "cls").select("id", "th", "at", "low", "high", "least")
