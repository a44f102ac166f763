"""The package on executors that don't have it installed."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    _sent.add(application)
    package = Path(__file__).resolve().parent
    staged = Path(tempfile.mkdtemp(prefix="weftline-"))
    shutil.copytree(package, staged / "source" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    made = shutil.make_archive(os.fspath(staged / "weftline"), "zip", staged / "source")
    spark.sparkContext.addPyFile(made)
    shutil.rmtree(staged / "source")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
