"""Every query against its SQL on the smallest data set, and the driver contract."""

import pytest

import __spark_entry__ as entry
from checks import compare, oracle, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(oracle.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare.compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
