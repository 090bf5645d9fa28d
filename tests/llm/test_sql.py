"""Queries that have SQL against it."""

import pytest

pytest.importorskip("duckdb")

from surveyloom.llm.registry import ORACLE, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None
