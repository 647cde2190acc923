"""Every named query against its SQL counterpart on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as entry
from vigilark.plans import catalog, oracle

QUERIES, SQL = catalog.QUERIES, oracle.build()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], SQL[name], SMALL) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    """Summaries of fitted models: every check in them holds."""
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    assert all(value is not False for row in rows for value in row)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
