import pytest


def brute_table(spark, rows, schema="doc_id long, text string"):
    """Rows in several partitions, with further columns whose names operators use inside."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("h", "id", "th", "n", "sha", "again", "node", "component_id", "keep_id", "bad", "gone", "all", "row")})


@pytest.fixture
def table(spark):
    return lambda rows, schema="doc_id long, text string": brute_table(spark, rows, schema)
