"""Every registered query with SQL agrees with DuckDB on all values."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    got = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert got["ok"], got["why"]
    assert "types differ" not in got["why"], got["why"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "signals", "hit_rate"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
