"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import os

import pytest
from oracle import connect, differences

from skein import registry

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, DATA), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
