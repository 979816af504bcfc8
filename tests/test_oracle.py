"""Every named query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_points
from comparison import oracle_rows, spark_rows
from provenant.plans.oracles import catalogue_sql
from provenant.plans.queries import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalogue()
ORACLES = catalogue_sql()


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == oracle_rows(ORACLES[name], SF_DIR)


def test_entry_points_offer_every_query():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_flagship(spark):
    assert entry_points.entry(spark).columns[:2] == ["site_id", "metric_date"]
