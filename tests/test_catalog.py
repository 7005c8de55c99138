"""Every registered query with SQL must give DuckDB's rows."""

import pytest

from posthound import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, spark, con):
    compare(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).columns
    assert catalog.QUERIES[name](spark, SF).count() > 0
