"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from tests.compare import same, views

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    views(c, D)
    return c


def _names():
    from quarryline.plans import catalogue

    return sorted(catalogue.SQL)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from quarryline.plans import catalogue

    state, n, _ = same(spark, con, name, catalogue.QUERIES[name], catalogue.SQL.get(name), D)
    assert state in ("same", "rows only"), state


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
