"""Every registered query with SQL equals its SQL in DuckDB; the others run and are stable."""

import pytest

from plinth import registry
from tests import compare

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare.differences(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike_twice(spark, sf_dir, name):
    first, second = (sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())
