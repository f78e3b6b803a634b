"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_point


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(entry_point.queries()[name](spark, sf_dir), con, entry_point.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
