from __future__ import annotations

import pytest

from tests.conftest import rows
from tillgrain.operators import cohort
from tillgrain.operators.grains import customer_months, invoice_grain
from tillgrain.plans import chart_feeds, customer_reports

LINES = [
    ("1", "A", "a", 1, "2010-12-01 08:00", 10, 1, "UK"),
    ("2", "A", "a", 1, "2010-12-05 08:00", 20, 2, "UK"),
    ("3", "A", "a", 1, "2011-01-05 08:00", 5, 1, "UK"),
    ("4", "A", "a", 1, "2011-01-06 08:00", 7, 3, "UK"),
    ("5", "A", "a", 1, "2011-03-06 08:00", 9, 2, "UK"),  # nothing in February
    ("6", "A", "a", 1, "2011-03-07 08:00", 1, 3, "UK"),
]


@pytest.fixture
def cells(make_sales):
    return cohort.cohort_cells(invoice_grain(make_sales(*LINES)))


def test_assignments(make_sales):
    got = cohort.assign_cohorts(make_sales(*LINES)).select(
        "InvoiceNo", "TransactionMonth", "CohortMonth", "CohortIndex"
    )
    assert rows(got) == [
        ("1", "2010-12", "2010-12", 0),
        ("2", "2010-12", "2010-12", 0),
        ("3", "2011-01", "2010-12", 1),
        ("4", "2011-01", "2011-01", 0),
        ("5", "2011-03", "2010-12", 3),
        ("6", "2011-03", "2011-01", 2),
    ]


def test_cells_and_matrices(cells):
    assert rows(cohort.cohort_counts(cells)) == [
        ("2010-12", 0, 2), ("2010-12", 1, 1), ("2010-12", 3, 1), ("2011-01", 0, 1), ("2011-01", 2, 1),
    ]
    assert rows(cohort.retention_matrix(cells)) == [
        ("2010-12", 100.0, 50.0, None, 50.0), ("2011-01", 100.0, None, 100.0, None),
    ]
    assert rows(cohort.revenue_matrix(cells).select("CohortMonth", "M0", "M1")) == [("2010-12", 15.0, 5.0), ("2011-01", 7.0, None)]
    assert rows(cohort.cohort_extent(cells)) == [(2, 3)]


def test_summary_and_extremes(cells):
    summary = cohort.cohort_summary(cohort.retention_long(cells))
    assert rows(summary) == [
        ("2010-12", 2, 50.0, 50.0, None, "Strong"),
        ("2011-01", 1, None, None, None, "Insufficient data"),
    ]
    best = cohort.best_and_worst(summary).first()
    assert (best.Best_Cohort, best.Worst_Cohort, best.Strong_Cohorts, best.Weak_Cohorts) == ("2010-12", "2010-12", 1, 0)


def test_chart_feeds(cells):
    retention = cohort.retention_long(cells)
    assert rows(cohort.average_curve(retention)) == [(0, 2, 100.0), (1, 1, 50.0), (2, 1, 100.0), (3, 1, 50.0)]
    assert chart_feeds.retention_curves(retention, months=0).count() == 0
    assert chart_feeds.retention_curves(retention).count() == 5


def test_month_over_month_retention_marks_gaps(make_sales):
    months = customer_months(invoice_grain(make_sales(*LINES)))
    assert rows(customer_reports.retention_mom(months)) == [
        ("2010-12", 2, 0, None, None, 0),
        ("2011-01", 2, 1, 50.0, 0, 0),
        ("2011-03", 2, 0, 0.0, 0, 1),
    ]


def test_wide_view_refuses_cells_past_its_last_column(spark):
    cells = spark.createDataFrame([("2011-01", 0, 5), ("2011-01", 3, 2)], "CohortMonth string, CohortIndex int, Customers bigint")
    assert rows(cohort.wide(cells, "Customers", 3)) == [("2011-01", 5, None, None, 2)]
    with pytest.raises(Exception, match="a cell lies past M2: M3"):
        cohort.wide(cells, "Customers", 2).collect()


def test_matrix_holds_every_cell(spark):
    from tillgrain.sources import tpch

    cells = cohort.cohort_cells(tpch.invoices(spark, "/root/testdata/sf0.001")).cache()
    matrix = cohort.retention_matrix(cells)
    filled = sum(v is not None for r in matrix.collect() for v in tuple(r)[1:])
    assert filled == cells.count() and cells.count() == cohort.retention_long(cells).count()
