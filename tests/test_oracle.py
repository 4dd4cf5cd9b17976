"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr),
    )


def test_every_query_has_sql():
    assert set(driver.own_queries()) == set(driver.own_sql())


@pytest.mark.parametrize("name", sorted(driver.own_queries()))
def test_query_equals_sql(spark, duck, name):
    result = driver.own_queries()[name](spark, SF_DIR)
    expected = duck.execute(driver.own_sql()[name])
    columns = [item[0] for item in expected.description]
    want = table(columns, expected.fetchall())
    got = table(result.columns, result.collect())
    assert got == want
    assert got[1]


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == driver.FOUND
    detectors = {row.detector for row in result.collect()}
    assert detectors == {"PortScanDetector", "BruteForceDetector", "BeaconingDetector"}
