"""Every registered query against its SQL on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_an_oracle():
    assert set(entry.own_queries()) == set(entry.own_oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.own_queries()))
def test_query(spark, duck, name):
    assert compare(entry.own_queries()[name](spark, DATA), duck, entry.own_oracle_sql()[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
