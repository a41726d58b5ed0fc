"""The registered queries beside their SQL on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from edgelytics.workload.oracle import ORACLE
from edgelytics.workload.queries import QUERIES
from tools.check import TABLES, normalised

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(ORACLE) <= set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = normalised(QUERIES[name](spark, SF).toPandas())
    want = normalised(duck.execute(ORACLE[name]).fetch_df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["neuropil", "nt", "syn_count", "count", "at_or_above"]
