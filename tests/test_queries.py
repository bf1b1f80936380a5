"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from echocache.plans.checks import CHECKS
from echocache.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_sql_belongs_to_queries():
    assert set(QUERIES) - set(CHECKS) == {"nearest_lsh"}
    assert set(CHECKS) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(spark, db, name):
    got = canonical(entry.queries()[name](spark, FOLDER).toPandas())
    want = canonical(db.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.map(repr).equals(want.map(repr))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
