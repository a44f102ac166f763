"""Connected components by alternating large and small stars, each round written to the shared folder.

Links that are few enough for one task, by their number, are settled there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.base import cut, joined, trimmed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of links for each component of these links: every other node to the smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = labels(len(nodes), at[: len(a)], at[len(a) :])
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each node's component; label: of an earlier call over the same nodes, refined."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            far = new[new]
            if np.array_equal(far, new):
                break
            new = far
        if np.array_equal(new, label):
            return new
        label = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((0, 2), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns], 1)])
        if len(held) > 1_000_000:
            yield _stars(held)
            held = held[:0]
    if len(held):
        yield _stars(held)


def _stars(held: np.ndarray) -> pa.RecordBatch:
    a, b = forest(held[:, 0], held[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Links that one task settles, 8 MB.
ONE_TASK = 500_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns], 1) for batch in batches]
    if held:
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels(len(nodes), at[:, 0], at[:, 1])])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """Links: longs a and b. For each node of a link: node and root, the smallest node it reaches.

    A round keeps a set of links; when two rounds have the same, it is a star for each component. A node of very many links is
    joined by broadcast.
    """
    links = cut(links.filter("a != b").mapInArrow(trimmed(_local), "a long, b long").distinct())
    if links.count() <= ONE_TASK:
        return cut(links.coalesce(1).mapInArrow(trimmed(_settled), "node long, root long"))
    while True:
        before = links
        both = links.union(links.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        links = cut(joined(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        linked = joined(links, least, "a")
        links = cut(linked.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        if links.count() == before.count() and links.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
