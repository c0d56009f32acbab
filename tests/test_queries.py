"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns[:3] == ["deviceid", "userid", "win"]
    assert df.count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
