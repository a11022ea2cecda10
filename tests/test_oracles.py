"""Every registered query runs; those with a DuckDB statement give its rows."""

import duckdb  # noqa: F401
import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["revision_id", "page_index", "preset"]
