"""Every query with SQL gives what DuckDB gives; the others run and have rows where the data must give some."""

import pytest

from shotlens.plans import registry
from tests.helpers import assert_same

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, folder, name):
    assert_same(spark, folder, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    n = df.count()
    assert n > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
