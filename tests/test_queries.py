"""Every grid query that has SQL gives the rows that DuckDB gives."""

import pytest

from gridloom.queries import QUERIES, SQL

from . import oracle

pytestmark = pytest.mark.skipif(not oracle.FOLDER.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    assert oracle.spark_rows(QUERIES[name](spark, str(oracle.FOLDER))) == oracle.sql_rows(connection, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, str(oracle.FOLDER)).count() > 0


def test_select_mask_vars_gives_no_rows_where_no_cell_fits(spark, tmp_path):
    # The first group has the quantity, the second the price, none has both.
    lines = spark.sql(
        """SELECT * FROM VALUES (26.0D, 53000.0D, 'A', TIMESTAMP_NTZ'1995-03-04'), (25.0D, 51000.0D, 'R', TIMESTAMP_NTZ'1996-05-06')
        AS t(l_quantity, l_extendedprice, l_returnflag, l_shipdate)"""
    ).selectExpr("*", "0.04D AS l_discount", "0.02D AS l_tax", "'F' AS l_linestatus")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = oracle.spark_rows(QUERIES["select_mask_vars"](spark, str(tmp_path)))
    assert found == oracle.sql_rows(oracle.connect(tmp_path), SQL["select_mask_vars"]) and not found[1]
    assert QUERIES["select_mask_vars"](spark, str(tmp_path)).dtypes == QUERIES["select_mask_vars"](spark, str(oracle.FOLDER)).dtypes


def test_entry_serves_them(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
