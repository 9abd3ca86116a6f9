"""Every catalogue query with a DuckDB statement equals it on the smallest tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

STATEMENTS = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(queries())


def test_entry_is_lazy_and_wide(spark):
    df = entry(spark)
    assert len(df.columns) == 29 and df.columns[0] == "customer_id"


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_query_equals_statement(spark, con, sf_dir, key):
    assert difference(spark, con, sf_dir, queries()[key], STATEMENTS[key]) == ""
