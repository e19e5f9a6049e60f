"""The registered queries of this package that have SQL give the same rows as it."""

import os

import pytest
from oracle import connect, differences

from skein.llm import queries

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name]) == ""
