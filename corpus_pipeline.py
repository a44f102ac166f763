"""Documents to training sequences: toxic ones go, copies and near copies leave one, test items' holders go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents, and what they
decide takes effect. Rows with nulls, empty texts, repeated ids and further columns pass as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, exact, packing, simhash, toxicity
from weftline.llm.base import cut, drop, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop(docs)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("exact dedup", _exact_dedup), ("SimHash near-dedup", _simhash), ("benchmark decontamination", _decontamination), ("packing", _packing)]

#: The stages' models and fingerprints are not expressible in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again for the next. What a stage wrote on its way goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = written()
        docs = cut(stage(spark, docs, sf_dir))
        drop(spark, before, keep=1)
    return docs
