"""Shared plumbing: scratch tables, Arrow helpers, input columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A column of ours beside all columns of a table: a name that none will have.
OWN = "__weftline_own_key"

_claimed: list = [None, None]


def claim(owner: str, forget: Callable[[], None]) -> None:
    """A Python worker serves one operator after another: what the last one has cached goes when the next one caches."""
    if _claimed[0] != owner:
        if _claimed[1]:
            _claimed[1]()
            trim()
        _claimed[:] = owner, forget


def trim() -> None:
    """Give freed memory back to the system: an idle Python worker would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch on its way to a Python worker, or a row's if that is more.
BATCH_BYTES = 4 << 20


def trimmed(run: Callable) -> Callable:
    """A function on Arrow batches that gives memory back when its task is done; the session's batches are kept small."""
    if session := SparkSession.getActiveSession():
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches: Python's objects of a whole one would take as much again."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Tables written by this process that are still there.
_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names. Only a session on one machine, as in tests, has a temporary one where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("executors share no folder: set spark.checkpoint.dir")
        found = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    _written.append(f"{found.rstrip('/')}/weftline/{uuid.uuid4().hex}")
    return _written[-1]


def written() -> int:
    """A mark for drop(): how many tables this process has written."""
    return len(_written)


def drop(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since a mark, but for the last `keep`. What still reads them fails: call it when results are written."""
    for path in _written[since : len(_written) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since : len(_written) - keep]


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost no more than their own tasks."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of the most rows that are joined by broadcast, and rows from which a key may be one.
HOTTEST, HOT_ROWS = 1000, 1000


def joined(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined with groups, whose column n tells how many rows each key has and goes.

    The HOTTEST keys of the most rows are sent to all executors, so their rows stay where they are, and no other key has more
    than a HOTTEST-th of all rows. groups should be a written table; it has few rows for each key.
    """
    hot = groups.filter(F.col(n) > HOT_ROWS).groupBy(key).agg(F.max(n).alias(n)).orderBy(F.desc(n), key).limit(HOTTEST).select(F.col(key).alias(OWN)).collect()
    groups = groups.drop(n)
    if not hot:
        return rows.join(groups, key)
    kind = next(f.dataType for f in groups.schema.fields if f.name == key)
    keys = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in hot], StructType([StructField(key, kind)])))
    return rows.join(F.broadcast(groups.join(keys, key)), key).unionByName(rows.join(keys, key, "left_anti").join(groups, key))


def picked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as long and the text as bytes, an empty one for null; other columns, whatever their names, are left out."""
    return df.select(F.col(key).cast("long").alias(key), raw(F.col(text)).alias(text))


def raw(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def mapped(df: DataFrame, make: Callable[[dict[str, list]], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """mapInArrow with batches as dicts of lists in and dicts of columns out. make may yield any number of dicts."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_types(schema)
        for batch in sliced(batches):
            out = make({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            for part in [out] if isinstance(out, dict) else out or ():
                yield to_batch(part, names, types)

    return df.mapInArrow(trimmed(run), schema)


def to_batch(columns: dict, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], type=t) for n, t in zip(names, types, strict=True)], names=names)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_types(schema: str) -> list[pa.DataType]:
    return [_TYPES[x.strip().split()[1]] for x in schema.split(",")]
