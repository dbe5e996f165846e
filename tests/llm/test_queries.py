"""Corpus queries with SQL against DuckDB; all of them on every row."""

import pytest

from gridloom.llm.queries import QUERIES, SQL

from .. import oracle

pytestmark = pytest.mark.skipif(not oracle.FOLDER.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, str(oracle.FOLDER))) == oracle.sql_rows(oracle.connect(), SQL[name])


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ("op3_html_extract", "op5_topk", "op6_packing")))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet")
    got = QUERIES[name](spark, str(oracle.FOLDER)).select("doc_id")
    assert got.count() == docs.count() and got.exceptAll(docs.select("doc_id")).count() == 0
