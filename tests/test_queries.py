"""Every registered query runs, and agrees exactly with its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
import harness

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pay_dau" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert harness.differences(QUERIES[name](spark, SF), ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
