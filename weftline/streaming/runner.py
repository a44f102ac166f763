"""Scripts over streams: each micro-batch is a table, and its number makes delivery idempotent.

What has been delivered is known by the folder of the batch, so a batch that runs again after a failure replaces its own output
and nothing is delivered twice. State beyond the batch is Structured Streaming's own: windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.plans.engine import Engine
from weftline.sources import files


def deliver(stream: DataFrame, script: str, folder: str, checkpoint: str, name: str = "events", kind: str = "parquet", tables: dict[str, DataFrame] | None = None, after: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Run the script over each micro-batch, known by `name`, beside tables that don't change, and write what it gives to
    folder/batch=<number>. By default all that is there is taken, and the query ends."""

    def batch(rows: DataFrame, number: int) -> None:
        engine = Engine(rows.sparkSession)
        for n, table in (tables or {}).items():
            engine.bind(n, table)
        out = engine.bind(name, rows).query(script)
        files.write(out, f"{folder}/batch={number}", kind)
        if after:
            after(out, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, time: str, keys: list[str], size: str, late: str, aggregates: dict[str, str], slide: str | None = None) -> DataFrame:
    """Aggregates by window and keys, of rows at most `late` behind; aggregates: name to SQL expression."""
    over = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(over, *keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def folder_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(folder)
