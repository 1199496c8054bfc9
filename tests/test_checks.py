"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    empty_is_right = ORACLES.get(name) is not None
    assert ok or (empty_is_right and "rows=0" in note), note


def test_entry_runs(spark):
    assert len(entry.entry(spark).take(1)) == 1
