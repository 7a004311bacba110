"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__
from __spark_entry__ import entry
from tillstream.catalog.oracles import ORACLES
from tillstream.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


def test_report_rows(spark):
    rows = QUERIES["aggregation_report"](spark, SF_DIR).collect()
    assert len({r.metric for r in rows}) == 12


def test_entry(spark):
    assert entry(spark).count() > 0
