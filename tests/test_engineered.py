"""The lines of engineered_sales are narrow while they are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillgrain.operators import features


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_engineered_lines_are_shuffled_narrow(spark, make_sales):
    data = [(str(i % 40), f"P{i % 11}", "x", 1 + i % 5, f"2011-0{1 + i % 9}-11 08:00", 1 + i % 7, None if i % 40 == 3 else i % 9, "UK") for i in range(200)]
    table = features.engineered_sales(make_sales(*data))
    plan = _plan(table)
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert "StockCode" in joins[-1]  # the deepest: products meet the lines first
    assert plan.count("year(") == 1 and plan.index("year(") < plan.index("Join ")
    bare = table.filter(F.col("CustomerID").isNull())
    assert bare.count() == 5
    assert [tuple(r) for r in bare.select("Frequency", "RFM_Score", "CustomerSegment", "TotalSpend", "BasketSize").distinct().collect()] == [(None,) * 5]
