"""Tables from and to files, by format.

Text formats are read by Spark's own readers; workbooks, which it has none for, a file at a time on the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import formats

#: File name ends and their formats. Fixed values.
ENDS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".txt": "text", ".log": "text", ".xml": "xml", ".parquet": "parquet", ".xlsx": "xlsx", ".orc": "orc"}
CONTENT = {"application/json": "json", "text/csv": "csv", "text/plain": "text", "application/xml": "xml", "text/xml": "xml", "application/vnd.apache.parquet": "parquet", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx"}


def format_of(path: str, told: str | None = None) -> str:
    """What is told, be it a format or a content type, else by the end of the name; binary if neither says."""
    if told:
        return CONTENT.get(told.split(";")[0].strip().lower(), told.lower())
    return ENDS.get(PurePosixPath(path.rstrip("/")).suffix.lower(), "binary")


def read(spark: SparkSession, path: str, kind: str | None = None, **options: Any) -> DataFrame:
    """A table of a file or folder. options: delimiter, quote, headers and skipRows for csv; rowTag and attributePrefix for xml; sheet
    and headers for xlsx; schema (DDL) for json and csv, so that nothing is read to infer it."""
    kind = format_of(path, kind)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("json", "jsonl"):
        reader = spark.read.option("multiLine", kind == "json")
        return (reader.schema(options["schema"]) if options.get("schema") else reader).json(path)
    if kind == "csv":
        return read_csv(spark, path, options)
    if kind == "text":
        return spark.read.text(path, wholetext=bool(options.get("whole")), lineSep=options.get("delimiter"))
    if kind == "xml":
        return spark.read.option("attributePrefix", options.get("attributePrefix", "@")).option("valueTag", "#text").option("ignoreNamespace", True).option("inferSchema", False).xml(path, rowTag=options.get("rowTag", "ROW"))
    if kind == "xlsx":
        return read_xlsx(spark, path, options)
    return spark.read.format("binaryFile").load(path)


def read_csv(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """All columns text, short rows filled with empty text. Without headers columns are A, B, ..."""
    skip, headers = int(options.get("skipRows") or 0), bool(options.get("headers", True))
    reader = spark.read.option("sep", (options.get("delimiter") or ",")[0]).option("quote", (options.get("quote") or '"')[0]).option("escape", '"').option("multiLine", True).option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "")
    if options.get("schema"):
        return reader.option("header", headers).schema(options["schema"]).csv(path)
    if not skip:
        df = reader.option("header", headers).csv(path)
        df = df if headers else df.toDF(*[formats.letters(k) for k in range(len(df.columns))])
        return df.na.fill("")
    # Lines to skip are those at the start of each file, so a file is parsed as one.
    files = spark.read.text(path, wholetext=True)
    told = {k: v for k, v in options.items() if k in ("delimiter", "quote", "headers", "skipRows")}
    names = list(formats.from_csv(files.first()[0], told)[0])

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [[r.get(n, "") for n in names] for r in formats.from_csv(s, told)])

    rows = files.select(F.explode(parse("value")).alias("r"))
    return rows.select(*[F.col("r")[k].alias(n) for k, n in enumerate(names)])


def read_xlsx(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Rows of a sheet of each workbook, all text; the columns are those of the first workbook."""
    told = {k: v for k, v in options.items() if k in ("sheet", "headers")}
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.first()
    rows = formats.from_xlsx(base64.b64encode(first[0]).decode(), told) if first else []
    names = list(rows[0]) if rows else ["A"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = formats.from_xlsx(base64.b64encode(content).decode(), told)
                yield pd.DataFrame([[r.get(n, "") for n in names] for r in found], columns=names)

    return files.mapInPandas(parse, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite", **options: Any) -> None:
    """A folder of files in a format. options: delimiter, headers and alwaysQuote for csv; compression; schema for parquet, as
    [{name, type}] to cast to; rowTag and rootElement for xml."""
    kind = format_of(path, kind)
    writer = lambda frame: frame.write.mode(mode).options(**({"compression": options["compression"]} if options.get("compression") else {}))
    if kind == "parquet":
        if options.get("schema"):
            df = df.select(*[F.col(f"`{c['name']}`").cast(TYPES[c.get("type", "string")]).alias(c["name"]) for c in options["schema"]])
        writer(df).parquet(path)
    elif kind == "orc":
        writer(df).orc(path)
    elif kind == "csv":
        flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
        writer(flat).option("sep", (options.get("delimiter") or ",")[0]).option("header", bool(options.get("headers", True))).option("quoteAll", bool(options.get("alwaysQuote"))).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "text":
        writer(df.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value"))).option("lineSep", options.get("delimiter") or "\n").text(path)
    elif kind == "xml":
        writer(df).option("rowTag", options.get("rowTag", "row")).option("rootTag", options.get("rootElement", "root")).option("attributePrefix", options.get("attributePrefix", "@")).xml(path)
    elif kind in ("json", "jsonl"):
        writer(df).json(path)
    else:
        raise ValueError(f"no sink for {kind}")


#: Column types of a Parquet schema. Fixed values.
TYPES = {"string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double", "bool": "boolean", "date": "date", "datetime": "timestamp", "decimal": "decimal(38,18)"}


def envelope(spark: SparkSession, path: str) -> tuple[Any, dict]:
    """A file {source, payload}: the payload, and the metadata that scripts see as $source. Any other JSON is its own payload."""
    whole = spark.read.text(path, wholetext=True).first()[0]
    value = formats.json.loads(whole)
    return (value["payload"], value["source"]) if isinstance(value, dict) and {"source", "payload"} <= value.keys() else (value, {})
