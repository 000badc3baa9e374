"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_module
import check

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = check.compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
