"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_module
from telltale.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry_has_sql_for_every_query():
    assert set(QUERIES) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    out = difference(entry_module.queries()[name](spark, SF), con, entry_module.oracle_sql()[name])
    assert out == "" or (out == "no rows" and name in MAY_BE_EMPTY), out


def test_the_comparison_sees_a_wrong_value(spark, con):
    df = spark.sql("SELECT 1L AS a, 'x' AS b")
    assert difference(df, con, "SELECT 1::BIGINT AS a, 'x' AS b") == ""
    assert "only SQL" in difference(df, con, "SELECT 2::BIGINT AS a, 'x' AS b")
    assert "types" in difference(df, con, "SELECT 1::INTEGER AS a, 'x' AS b")
    assert "columns" in difference(df, con, "SELECT 1::BIGINT AS a")
