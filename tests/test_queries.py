"""Every named query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# the training-data queries have tests of their own
MINE = {k: f for k, f in entry.queries().items() if f.__module__.startswith("surveyloom.plans")}
QUERIES, ORACLE = MINE, {k: v for k, v in entry.oracle_sql().items() if k in MINE}
# No SQL form: sketches, iterative models, p-values of t, hashed samples.
WITHOUT_SQL = {
    "index_by_band_approx": 3,
    "percentiles_approx": 10,
    "model_terms": 7,
    "residual_sample": 5000,
    "importance_forest": 6,
    "segments": 3,
    "segment_stats": 3,
    "segment_crosstab": 3,
    "segment_centres": 12,
    "segment_profile": 4,
    "segment_outcomes": 4,
    "cluster_summary": 4,
    "silhouette": 1,
    "codebook_profile": 6,
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry_is_complete():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_its_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() == WITHOUT_SQL[name]


def test_entry(spark):
    assert entry.entry(spark).count() == 3
