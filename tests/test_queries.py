"""Every registered query runs and agrees with its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def oracle(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, oracle, name):
    ok, note = compare(spark, oracle, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
