"""Every registered query against its oracle, the others against a row check."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, key):
    _, problems = compare(QUERIES[key](spark, sf), con, ORACLES[key])
    assert not problems


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r["feature"] for r in rows if r["drift"]] == ["l_quantity"]
