"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, QUERIES, ORACLES) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "position"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
