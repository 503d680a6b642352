"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from campanula.registry import load
from tools.compare import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_of_the_library_has_sql():
    assert {name for name, q in load().items() if q.sql} == set(load()) and set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["account_no"] and out.count() > 0


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    _, problem = differences(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert problem is None
