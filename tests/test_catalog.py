"""Every registered query with SQL against DuckDB on the test tables."""

import os

import pytest

from tests.oracle import connect, differences
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], duck) is None


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
