"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only their rows shuffle.

The hashes alone, eight bytes a row, are dealt to as many parts as there are, each with two filters of its own. What these find
makes one filter for all rows, bounded in size; rows that it does not have pass straight through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.base import cut, joined
from weftline.llm.copies import member


def _digest(text: str, normalise: Callable[[Column], Column] | None) -> Column:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.sha2((normalise(whole) if normalise else whole).cast("binary"), 256)


def decisions(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its key, keep_id (the key that stays of its group of equal texts: the largest), group_size, kept and text_sha256.

    normalise maps the text to what is compared; by default nothing changes. Null texts count as empty ones and equal those.
    A null key is smaller than any other. Of rows that share the largest key and the text exactly one is kept. An empty table
    gives an empty one; other columns are ignored.
    """
    rows = cut(docs.select(F.col(key).cast("long").alias("id"), F.unhex(_digest(text, normalise)).alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("h", F.xxhash64("sha"))
    suspect = member(docs.sparkSession, bloom.repeating(rows.select("h")))
    tested = rows.withColumn("again", suspect("h"))
    again = tested.filter("again")
    # A group of copies is one partial row for each task before it moves.
    groups = cut(again.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n")))
    out = [F.col("id").alias(key)]
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = tested.filter(~F.col("again")).select(*out, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(joined(again, groups, "sha", "rows").select(*out, F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.row") == F.col("row")).alias("kept"), sha))


def drop(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that decisions() keeps, with all their columns. Rows whose text can't repeat don't move."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(key).cast("long").alias("id"), _digest(text, normalise).alias("sha")).withColumn("h", F.xxhash64("sha"))
    suspect = member(docs.sparkSession, bloom.repeating(rows.select("h")))
    tested = rows.withColumn("again", suspect("h"))
    one = tested.filter("again").groupBy("sha").agg(F.max_by("all", F.coalesce("id", F.lit(-(1 << 63)))).alias("all"))
    return tested.filter(~F.col("again")).select("all.*").unionByName(one.select("all.*"))
