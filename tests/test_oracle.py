"""Every registered query runs; those with SQL agree with it in names, types and all rows."""

import pytest

import __spark_entry__ as entry
from tests import oracle
from wavecohort.catalog import views

# The queries over documents have tests of their own, next to their subpackage's.
QUERIES = {n: f for n, f in entry.queries().items() if n in views.QUERIES}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in views.ORACLE}
# Fitted by repeated MLlib jobs; slow and covered by test_models.
SLOW = {"svm_rbf", "svm_cost", "svm_platt"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(QUERIES[name](spark, sf), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(5).collect()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 16 and "mean_accuracy" in df.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
