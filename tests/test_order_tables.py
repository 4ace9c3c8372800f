"""Queries over order tables reduce the lines before they are joined and shuffled."""

from __future__ import annotations

from datetime import datetime

import pytest
from tillgrain.operators import features, rfm
from tillgrain.plans import catalog, sales_reports
from tillgrain.sources import tpch


@pytest.fixture
def folder(spark, tmp_path):
    """Orders and lines with a repeated header, null keys, a lone line and equal amounts."""
    day = lambda m, d: datetime(2011, m, d)
    orders = [(1, 7, day(1, 3)), (2, 7, day(2, 1)), (2, 7, day(2, 1)), (3, None, day(2, 5)), (4, 8, day(2, 9)), (4, 9, day(3, 9)), (None, 8, day(3, 1)), (5, 8, None)]
    lines = [(1, 1, 2.0, 10.0), (1, 2, 2.0, 10.0), (1, 3, 1.0, 4.5), (2, 1, 3.0, 9.99), (2, 1, 3.0, 9.99), (2, 2, 1.0, None), (3, 1, 1.0, 7.0), (4, 2, 5.0, 50.0), (4, 3, 5.0, 20.0), (5, 1, 1.0, 3.0), (6, 1, 1.0, 3.0), (None, 1, 1.0, 3.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _reduced_before_the_join(plan: str) -> bool:
    return "Aggregate" in plan[plan.rindex("Join ") :]


def test_new_vs_returning_reduces_lines_before_the_header(spark, folder):
    got = catalog.QUERIES["new_vs_returning"](spark, folder)
    lines = tpch.sales_lines(spark, folder, ("CustomerID", "InvoiceNo", "InvoiceDate", "TotalAmount"))
    assert _rows(got) == _rows(sales_reports.new_vs_returning(lines)) != []
    assert _reduced_before_the_join(_plan(got))


def test_code_segments_reduce_lines_before_the_header(spark, folder, monkeypatch):
    seen = []
    real = rfm.materialize
    monkeypatch.setattr(rfm, "materialize", lambda df: seen.append(_plan(df)) or real(df))
    got = _rows(catalog.QUERIES["rfm_code_segments"](spark, folder))
    assert _reduced_before_the_join(seen[0])
    lines = tpch.sales_lines(spark, folder, ("InvoiceNo", "CustomerID", "InvoiceDate", "Quantity", "UnitPrice"))
    assert got == _rows(catalog._portable(features.rfm_code_stats(features.revenue_invoices(lines)))) != []


def test_a_task_reads_a_bounded_share(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        tpch.tune(spark)
        assert spark.conf.get(key) == "16MB"
        spark.conf.set(key, "8m")
        tpch.tune(spark)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, before)
