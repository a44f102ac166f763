"""What the operators on shared passages have in common: whole copies set apart, and marked spans cut out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftline.llm import bloom
from weftline.llm.base import cut, joined, raw, sliced, trimmed

#: Stands for a null doc_id: smaller than any other.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """id, th (64 bits of the text's hash; rows of one id with different texts differ in it) and the text as bytes."""
    text = raw(F.col("text"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def member(spark, f: bloom.Filter) -> Callable[[str], Column]:
    """A filter sent to the executors, as a function on a column of longs."""
    sent = spark.sparkContext.broadcast(f.bits)

    @arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(bloom.Filter(sent.value).test(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return test


def set_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """keyed() rows to work, members and suspects.

    work: (id, th, n, text), all rows with n 0 and, of each text that has or may have copies, one more, with the smallest id and
    the number of copies. `distinct` takes from its batches each different text once, by the suspects. members: (id, th, least),
    every row of a text with copies and the smallest id of them. Only rows that may be copies move.
    """
    again = bloom.repeating(rows.select("th"))
    suspect = member(rows.sparkSession, again)
    some = rows.filter(suspect("th")).withColumn("sha", F.sha2("text", 256))
    firsts = cut(some.groupBy("sha").agg(F.min("id").alias("id"), F.first("th").alias("th"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text")))
    several = firsts.filter("n > 1").select("sha", F.col("id").alias("least"), F.col("n").alias("rows"))
    work = rows.select("id", "th", F.lit(0).cast("long").alias("n"), "text").unionByName(firsts.select("id", "th", "n", "text"))
    return work, joined(some.select("id", "th", "sha"), several, "sha", "rows").select("id", "th", "least"), rows.sparkSession.sparkContext.broadcast(again.bits)


def distinct(batches: Iterator[pa.RecordBatch], suspects: Broadcast, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of work with each different text once, in parts of so many rows."""
    again = bloom.Filter(suspects.value)
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            some = batch.slice(k, size)
            n, th = (some.column(c).to_numpy(zero_copy_only=False) for c in ("n", "th"))
            keep = (n > 0) | ~again.test(th.view(np.uint64))
            if keep.any():
                yield some.filter(pa.array(keep))


def carve(rows: DataFrame, spans: DataFrame, whole: DataFrame, split: Callable[[bytes], list | bytes], join: Callable[[list], bytes]) -> DataFrame:
    """spans: (id, th, first, last) of removed windows, half-open, in units of split(); whole: (id, th) of rows that go entirely.

    Gives doc_id, n (units), spans (flat, maximal) and kept.
    """
    gone = whole.select("id", "th", F.lit(0).alias("first"), F.lit(2**31 - 1).alias("last"))
    marks = spans.unionByName(gone).groupBy("id", "th").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    marks = cut(marks)
    # Texts without marks don't move, but for the few that a filter takes for marked ones.
    has = member(rows.sparkSession, bloom.build(marks.select("th"), marks.count()))
    rows = rows.withColumn("marked", has("th"))
    none = F.lit(None).cast("array<int>")
    marked = rows.filter("marked").join(marks, ["id", "th"], "left").select("id", "text", "firsts", "lasts").union(rows.filter("not marked").select("id", "text", none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: tuple[list, list, list, list] = [], [], [], []
            for doc_id, text, firsts, lasts in zip(*(x.to_pylist() for x in batch.columns)):
                units = split(text)
                found = union(np.array(firsts), np.array(lasts), len(units)) if firsts else []
                if found:
                    text = join([x for a, b in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(units)]) for x in ([units[a:b]] if b > a else [])])
                elif not isinstance(units, bytes):
                    text = join([units])
                for part, x in zip(out, (None if doc_id == NO_ID else doc_id, len(units), [y for ab in found for y in ab], text)):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.binary())], names=["doc_id", "n", "spans", "kept"])

    return marked.mapInArrow(trimmed(run), "doc_id long, n long, spans array<int>, kept binary")


def union(firsts: np.ndarray, lasts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Half-open intervals as the maximal runs that they cover, within n units."""
    order = np.argsort(firsts, kind="stable")
    firsts, ends = firsts[order], np.maximum.accumulate(np.minimum(lasts[order], n))
    new = np.flatnonzero(firsts[1:] > ends[:-1]) + 1
    return [(int(a), int(b)) for a, b in zip(firsts[np.append(0, new)], ends[np.append(new - 1, len(ends) - 1)]) if b > a]


def removed() -> Column:
    """Units in flat spans: the sum of ends less starts."""
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
