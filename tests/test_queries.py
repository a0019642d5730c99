"""Every registered query against its SQL (or for rows only) on the smallest data set."""

import pytest
from compare import compare, connection

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok or (SQL.get(name) is not None and note.startswith("rows=0")), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
