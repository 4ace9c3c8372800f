from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillgrain.operators import cleaning

DAY = "2011-05-04 10:00"


def test_rules(make_lines):
    raw = make_lines(
        ("536365", "A", "a", 2, DAY, 1.5, 1, "UK"),
        ("C36366", "A", "a", 2, DAY, 1.5, 1, "UK"),
        ("536367", "A", "a", 0, DAY, 1.5, 1, "UK"),
        ("536368", "A", "a", -3, DAY, 1.5, 1, "UK"),
        ("536369", "A", "a", 1, DAY, 0, 1, "UK"),
        ("536370", "A", "a", 1, DAY, 2, None, "UK"),
    )
    kept = cleaning.completed_sales(raw).select("InvoiceNo", F.col("TotalAmount").cast("string"), "YearMonth")
    assert rows(kept) == [("536365", "3.0000", "2011-05")]


def test_outliers_are_cut_at_the_quantile_of_surviving_rows(make_lines):
    quantities = [*range(1, 101), 5000]
    raw = make_lines(
        *[(str(i), "A", "a", q, DAY, 1, 1, "UK") for i, q in enumerate(quantities)],
        ("C1", "A", "a", 9_000_000, DAY, 1, 1, "UK"),
    )
    limit = np.quantile(quantities, 0.99)
    kept = [r.Quantity for r in cleaning.clean_sales(raw).collect()]
    assert sorted(kept) == [q for q in quantities if q <= limit]


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantile_interpolates(spark, n, fraction):
    values = [(i * 37 % 101) / 4 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(F.col("x").cast("decimal(12,2)"))
    got = cleaning.exact_quantile(df, "x", fraction).first()
    assert got.threshold == pytest.approx(np.quantile(values, fraction), abs=1e-9)
    assert float(got.largest_kept) == max(v for v in values if v <= np.quantile(values, fraction) + 1e-9)


def test_quantile_needs_exact_types(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(TypeError):
        cleaning.exact_quantile(df, "x", 0.5)


def test_quantile_of_fine_decimals(spark):
    from decimal import Decimal

    values = [Decimal(x).scaleb(-8) for x in (-7, 503, 507, 10**15 + 1)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(24,8)")
    found = cleaning.exact_quantile(df, "v", 0.5).first()
    assert found.threshold == pytest.approx(5.05e-06) and found.largest_kept == values[1]
    assert {r.v for r in cleaning.drop_outliers(df, "v", 0.5).collect()} == set(values[:2])


def test_quantile_refuses_what_does_not_fit(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal(10) ** 20,)], "v decimal(30,2)")
    with pytest.raises(Exception, match="too large"):
        cleaning.exact_quantile(df, "v", 0.5).collect()
