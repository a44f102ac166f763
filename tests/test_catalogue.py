"""Every query of the catalogue against DuckDB on the smallest test tables."""

import decimal
import os

import duckdb
import pytest

from weftline.plans.catalogue import CATALOGUE, ORACLES, QUERIES, TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n, _, _ in CATALOGUE])
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    told = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert told == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)
