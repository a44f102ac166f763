"""The engine: tables by name, scripts to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.lang.evaluate import evaluate
from weftline.lang.parser import parse
from weftline.plans.lower import Lowering, scanned
from weftline.plans.typed import Frame, typed


class Engine:
    """Scripts over bound tables. A table is known by its name and as $.name; other bindings are literals."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Frame] = {}
        self.literals: dict[str, Any] = {}
        self.columns: dict[str, Callable] = {}
        self.plain: dict[str, Callable] = {}

    def bind(self, name: str, table: DataFrame) -> Engine:
        self.tables[name] = scanned(table)
        return self

    def bind_folder(self, folder: str, *names: str) -> Engine:
        """Parquet tables of a folder."""
        for name in names:
            self.bind(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def let(self, name: str, value: Any) -> Engine:
        self.literals[name] = value
        return self

    def register(self, name: str, column: Callable | None = None, plain: Callable | None = None) -> Engine:
        """A method of the host: column(receiver, arguments) on typed columns, plain(receiver, arguments) on values. Built-in methods come first."""
        if column:
            self.columns[name] = column
        if plain:
            self.plain[name] = plain
        return self

    def query(self, script: str, ordered: bool = False) -> DataFrame:
        """ordered: rows come in the order of the items, also where the script doesn't sort; else only where it does."""
        lowering = Lowering(self.spark, self.columns)
        names = {**self.tables, **{k: typed(v) for k, v in self.literals.items()}, "$": dict(self.tables), "$root": dict(self.tables)}
        return lowering.result(lowering.run(parse(script), names), ordered)

    def documents(self, df: DataFrame, column: str, script: str, into: str = "result") -> DataFrame:
        """A script over each row's JSON text, as JSON text: for documents whose shape is known only when they are read."""
        functions, bindings = dict(self.plain), dict(self.literals)
        parse(script)

        @F.pandas_udf(T.StringType())
        def run(texts):  # type: ignore[no-untyped-def]
            import json

            from weftline.functions.values import dump

            return texts.map(lambda s: dump(evaluate(script, None if s is None else json.loads(s), bindings, functions)))

        return df.withColumn(into, run(F.col(column).cast("string")))
