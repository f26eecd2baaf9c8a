"""Queries with SQL against DuckDB, on the smallest tables."""

import pytest

from foliant.llm import queries, sql
from tests import test_catalog


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, name):
    test_catalog.same(queries.queries()[name](spark, test_catalog.FOLDER).toPandas(), test_catalog.rows_of_sql(sql.oracle_sql()[name]))
