"""Every registered query against its SQL oracle, or at least for rows."""

import oracle
import pytest

import __spark_entry__ as driver
from creditloom.plans import QUERIES

# Queries that train models are in test_model_queries.
WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None and not q.trains]
WITHOUT_SQL = [n for n, q in QUERIES.items() if q.sql is None and not q.trains]


@pytest.fixture(scope="module")
def con(sf001):
    return oracle.connect(sf001)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, sf001, con, name):
    assert oracle.compare(QUERIES[name].build(spark, sf001), con, QUERIES[name].sql) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_has_rows(spark, sf0001, name):
    assert QUERIES[name].build(spark, sf0001).count() > 0


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_names_follow_the_rules():
    assert not [n for n in QUERIES if n.startswith("op") or "pipeline" in n]
