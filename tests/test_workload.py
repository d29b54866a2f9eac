"""Every registered query against its SQL twin."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from feedloom.workload.oracles import all_oracles
from feedloom.workload.queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_oracles())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", all_queries())
def test_query(spark, con, name):
    difference, n = compare(spark, con, SF, name)
    assert difference == ""
    assert n > 0
