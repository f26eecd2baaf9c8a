"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foliant import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def rows_of_sql(sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con.execute(sql).df()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    same(catalog.queries()[name](spark, FOLDER).toPandas(), rows_of_sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_merged_spans_of_odd_quantities(spark, tmp_path):
    """Parts of a unit are rounded, halves to even, and a missing quantity does not break a span."""
    path = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"copy (select * from (values (1, 7, 1, 4.5::double), (1, 7, 1, 0.6), (1, 7, 2, null), (1, 7, 2, 9.5), (1, 7, 3, 2.5), (2, 7, null, 1.0), (2, 7, 1, 1.5)) t(l_orderkey, l_partkey, l_linenumber, l_quantity)) to '{path}'")
    want = duckdb.sql(catalog.oracle_sql()["merged_spans"].replace("from lineitem", f"from '{path}'")).df()
    same(catalog.queries()["merged_spans"](spark, str(tmp_path)).toPandas(), want)
