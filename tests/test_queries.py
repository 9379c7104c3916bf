"""Every query against its SQL in DuckDB, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, sf, name):
    assert len(QUERIES[name](spark, sf).collect()) > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tenant_id", "label", "recommended_action", "n", "mean_score"]
    assert df.count() > 0
