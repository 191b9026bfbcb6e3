"""Every registered analytics query against DuckDB on the driver's tables."""

import pytest

from tests.conftest import compare
from tracelens import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
