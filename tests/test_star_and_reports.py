from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillgrain.operators import quality, rfm
from tillgrain.operators.grains import invoice_grain
from tillgrain.operators.star import (
    Star,
    as_published,
    dim_products,
    fact_transactions,
    lines_of_fact,
)
from tillgrain.plans import chart_feeds, customer_reports, flows, sales_reports
from tillgrain.sources import tpch
from tillgrain.sources.schemas import STAR_TYPES

UK = "United Kingdom"


def some_lines(make_sales, customers=12):
    rows_ = []
    for c in range(1, customers + 1):
        for k in range(1 + c % 4):
            day = f"2011-{1 + (c * k) % 9:02d}-{1 + c:02d} 1{k}:00"
            land = UK if c % 3 else "France"
            rows_ += [(f"{c}-{k}", f"P{(c + j) % 5}", f"item {(c + j) % 5}", 1 + j, day, 1.25 * (c + j + 1), c, land) for j in range(3)]
    return make_sales(*rows_)


@pytest.fixture
def lines(make_sales):
    return some_lines(make_sales)


def test_star_round_trip_and_checks(spark, lines, tmp_path):
    Star.build(lines).write(str(tmp_path))
    star = Star.read(spark, str(tmp_path))
    assert star.fact_transactions.count() == lines.count()
    assert all(r.orphans == 0 for r in quality.foreign_keys(star).collect())
    assert all(r.duplicates == 0 and r.nulls == 0 for r in quality.primary_keys(star).collect())
    assert all(r.violations == 0 for r in quality.value_rules(star).collect())
    counts = quality.expected_row_counts(quality.row_counts(star))
    assert {r.tbl: r.ok for r in counts.collect()}["dim_customers"] == 0
    for name, types in STAR_TYPES.items():
        stored = dict(getattr(star, name).dtypes)
        assert {c: {"year": "int", "month": "int"}.get(c, k) if name == "fact_transactions" else k for c, k in types.items()} == stored
    wide = star.dim_customers.withColumn("frequency", F.lit(2**40))
    with pytest.raises(Exception, match="dim_customers.frequency exceeds int"):
        as_published(wide, "dim_customers").collect()
    month = star.fact_transactions.filter("year = 2011 and month = 1")
    assert "PartitionFilters: [isnotnull(year" in month._jdf.queryExecution().toString()
    # every report input can be rebuilt from the stored fact
    again = rfm.rfm_segments(invoice_grain(lines_of_fact(star.fact_transactions)))
    assert rows(again, "CustomerID", "Segment") == rows(star.dim_customers, "customerid", "segment")


def test_checks_find_what_is_wrong(spark, lines):
    star = Star.build(lines)
    broken = replace(
        star,
        dim_customers=star.dim_customers.filter("customerid <> 1").withColumn("r_score", F.lit(6)),
        dim_geography=star.dim_geography.unionByName(star.dim_geography),
        fact_transactions=star.fact_transactions.withColumn(
            "quantity", F.when(F.col("customerid") != 2, F.col("quantity"))
        ),
    )
    of_one = lines.filter("CustomerID = 1").count()
    of_two = lines.filter("CustomerID = 2").count()
    orphans = {r.foreign_key: r.orphans for r in quality.foreign_keys(broken).collect()}
    assert orphans == {
        "customerid -> dim_customers": of_one, "stockcode -> dim_products": 0,
        "datekey -> dim_date": 0, "country -> dim_geography": 0,
    }
    assert {r.tbl: r.duplicates for r in quality.primary_keys(broken).collect()}["dim_geography"] == 2
    violations = {r.rule: r.violations for r in quality.value_rules(broken).collect()}
    assert violations["fact_transactions.quantity not null"] == of_two
    assert violations["dim_customers.r_score 1 to 5"] == 11


def test_load_check_reads_the_fact(spark, lines):
    star = Star.build(lines)
    whole = rows(quality.segment_revenue(star.fact_transactions, star.dim_customers), "segment", "total_revenue", "avg_line_value")
    half = star.fact_transactions.filter("pmod(hash(stockcode), 2) = 0")
    assert rows(quality.segment_revenue(half, star.dim_customers), "segment", "total_revenue", "avg_line_value") != whole
    total = sum(r.total_revenue for r in quality.segment_revenue(star.fact_transactions, star.dim_customers).collect())
    assert total == pytest.approx(float(lines.agg(F.sum("TotalAmount")).first()[0]), abs=5)


def test_key_faults_of_given_tables(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1), (3, 9)], "k int, f int")
    b = spark.createDataFrame([(1,), (2,)], "p int")
    got = quality.table_keys({"a": a, "b": b}, {"a": ["k"], "b": ["p"]}, {("a", "f"): ("b", "p")})
    assert rows(got) == [
        ("a", "f unmatched", 1, 1), ("a", "missing", 1, 1), ("a", "repeated", 1, 2),
        ("b", "missing", 0, 0), ("b", "repeated", 0, 0),
    ]


def test_orders_are_rows_where_the_grain_is_unique(spark):
    report = sales_reports.monthly_revenue(tpch.invoices(spark, "/root/testdata/sf0.001"))
    base = tpch.invoices(spark, "/root/testdata/sf0.001").groupBy("CustomerID").agg(F.count(F.lit(1)))
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    scores = rfm.rfm_base(tpch.invoices(spark, "/root/testdata/sf0.001")).select("CustomerID", "Frequency")
    assert rows(scores) == rows(base)


def test_nine_reference_rows_are_the_broadcast_side(spark):
    star = Star.build(tpch.sales_lines(spark, "/root/testdata/sf0.001"))
    plan = customer_reports.winback_list(star.dim_customers, star.dim_rfm_segments)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_engineered_sales_reads_its_lines_once_and_splits_a_hot_customer(spark, make_sales):
    from tillgrain.operators import features

    data = [(str(i), f"P{i % 11}", f"text {i}", 1 + i % 5, f"2011-0{1 + i % 9}-11 08:00", 1 + i % 7, 7 if i % 3 else i, UK) for i in range(3000)]
    lines = make_sales(*data)
    seen = []
    real = features.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(features, "materialize", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
        result = features.engineered_sales(lines)
        plans = [*seen, result._jdf.queryExecution().optimizedPlan().toString()]
    assert sum("LogicalRDD" in p or "LocalRelation" in p for p in plans) == 1
    assert result.count() == 3000


def test_first_description_wins(make_sales):
    lines = make_sales(
        ("2", "A", "later", 1, "2011-01-02 00:00", 2, 1, UK),
        ("1", "A", None, 1, "2011-01-01 00:00", 4, 2, UK),
        ("1", "A", "earlier", 1, "2011-01-01 09:00", 6, 2, UK),
        ("3", "B", None, 1, "2011-01-01 09:00", 6, 2, UK),
    )
    got = dim_products(lines).select("stockcode", "description", "avgunitprice", "popularityscore")
    assert rows(got) == [("A", "earlier", 4.0, 1.0), ("B", None, 6.0, 0.5)]


def test_recency_counts_full_days(make_sales):
    invoices = invoice_grain(
        make_sales(
            ("1", "A", "a", 1, "2011-01-01 22:00", 1, 1, UK), ("2", "A", "a", 1, "2011-01-02 01:00", 1, 2, UK)
        )
    )
    assert rows(rfm.rfm_base(invoices), "CustomerID", "Recency", "Frequency") == [(1, 1, 1), (2, 1, 1)]


def test_customers_in_two_countries_count_in_both(make_sales):
    lines = make_sales(
        ("1", "A", "a", 1, "2011-01-01 22:00", 10, 1, UK), ("2", "A", "a", 1, "2011-01-02 01:00", 30, 1, "France")
    )
    got = Star.build(lines).dim_geography.select("country", "isuk", "uniquecustomers", "revenuerank")
    assert rows(got) == [("France", 0, 1, 1), (UK, 1, 1, 2)]


def test_report_invariants(spark, lines):
    star = Star.build(lines)
    invoices = invoice_grain(lines)
    total = float(lines.agg(F.sum("TotalAmount")).first()[0])
    overview = customer_reports.segment_overview(star.dim_customers, star.dim_rfm_segments).collect()
    assert sum(r.Customers for r in overview) == 12
    assert sum(r.Total_Revenue_GBP for r in overview) == pytest.approx(total, abs=len(overview))
    assert [r.Segment for r in overview] == sorted(
        (r.Segment for r in overview), key=[x[0] for x in rfm.SEGMENT_REFERENCE].index
    )
    attached = customer_reports.with_line_counts(star.dim_customers.drop("lines"), star.fact_transactions)
    assert [tuple(r) for r in customer_reports.segment_overview(attached, star.dim_rfm_segments).collect()] == [
        tuple(r) for r in overview
    ]
    months = sales_reports.monthly_revenue(invoices).collect()
    assert months[-1].Cumulative_Revenue_GBP == pytest.approx(total, abs=1)
    assert months[0]["MoM_Growth_%"] is None
    split = sales_reports.new_vs_returning_by_order(invoices).collect()
    assert sum(r.Orders for r in split) == lines.select("InvoiceNo").distinct().count()
    assert sum(r.Orders for r in split if r.Customer_Type == "New Customer") == 12
    sizes = [r.size for r in chart_feeds.rfm_scatter(star.dim_customers).collect()]
    assert min(sizes) == 10.0 and max(sizes) == 210.0


def test_equal_amounts_of_an_invoice_count_once(make_sales):
    lines = make_sales(
        ("1", "A", "a", 1, "2011-01-01 08:00", 5, 1, UK),
        ("1", "B", "b", 1, "2011-01-01 08:00", 5, 1, UK),
        ("1", "C", "c", 1, "2011-01-01 08:00", 3, 1, UK),
        ("2", "C", "c", 1, "2011-02-01 08:00", 3, 1, UK),
    )
    assert rows(sales_reports.new_vs_returning(lines)) == [
        ("2011-01", "New Customer", 1, 3.0, 37.5),
        ("2011-01", "Returning Customer", 1, 5.0, 62.5),
        ("2011-02", "Returning Customer", 1, 3.0, 100.0),
    ]


def test_flows_from_csv_to_results(spark, tmp_path):
    head = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    body = "".join(
        f"{'C' if i % 11 == 0 else ''}{500 + i},P{j},item {j},{1 + (i + j) % 4},{1 + i % 12}/{1 + i % 28}/2011 9:{10 + i},{1 + j}.50,{i % 9}.0,United Kingdom\n"
        for i in range(45)
        for j in range(4)
    )
    (tmp_path / "raw.csv").write_text(head + body)
    sales = f"{tmp_path}/sales"
    cleaned = flows.run_cleaning(spark, f"{tmp_path}/raw.csv", sales)
    assert cleaned.filter(F.col("InvoiceNo").startswith("C")).count() == 0
    assert flows.run_features(spark, sales, f"{tmp_path}/features").count() == cleaned.count()
    assert flows.run_rfm(spark, sales, f"{tmp_path}/rfm")["rfm_scores"].count() == 9
    flows.run_cohorts(spark, sales, f"{tmp_path}/cohorts")
    pairs = flows.run_baskets(spark, sales, f"{tmp_path}/baskets")["top_product_pairs"]
    assert pairs.count() == 12
    assert spark.read.option("header", True).csv(f"{tmp_path}/baskets/top_product_pairs").count() == 12
    star, checks = flows.run_warehouse(spark, sales, f"{tmp_path}/star")
    assert all(r.orphans == 0 for r in checks["foreign_keys"].collect())
    assert star.fact_transactions.count() == cleaned.count()


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


def test_hot_keys_change_nothing(spark, make_sales, tmp_path):
    """One customer, order and product with a third of all lines, with joins split at run time."""
    rng = random.Random(5)

    def line(i, invoice, sku, customer):
        text = f"{rng.getrandbits(400):x}"  # incompressible, so that partition sizes show the skew
        return (invoice, sku, text, 1 + i % 5, f"2011-0{1 + int(invoice) % 9}-11 08:00", 1 + i % 7, customer, UK)

    data = [line(i, str(i % 90), f"P{i % 11}", i % 90 % 30) for i in range(900)]
    data += [line(i, "9999", "P3", 7) for i in range(450)]
    lines = make_sales(*data)
    path = f"{tmp_path}/lines"
    lines.repartition(6).write.parquet(path)
    lines = spark.read.parquet(path)
    from tillgrain.operators import cohort, features

    def results():
        return [
            rows(features.engineered_sales(lines), "InvoiceNo", "StockCode", "Quantity", "TotalSpend", "BasketSize", "ProductTransactions", "RFM_Score"),
            rows(cohort.assign_cohorts(lines), "InvoiceNo", "StockCode", "Quantity", "CohortIndex"),
            rows(rfm.rfm_segments(invoice_grain(lines)), "CustomerID", "Frequency", "RFM_Score", "Segment"),
        ]

    plain = results()
    before = {k: spark.conf.get(k) for k in SKEW}
    try:
        for key, value in SKEW.items():
            spark.conf.set(key, value)
        assert results() == plain
        for joined in (features.customer_features(lines), features.order_features(lines), features.product_features(lines), cohort.assign_cohorts(lines)):
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(plain[0]) == 1350


def test_invoice_view_equals_grain_of_lines(spark):
    folder = "/root/testdata/sf0.001"
    direct = tpch.invoices(spark, folder, country=True)
    derived = invoice_grain(tpch.sales_lines(spark, folder))
    columns = ["InvoiceNo", "CustomerID", "Country", "Lines", "Quantity", F.col("Amount").cast("double").alias("a")]
    assert rows(direct.select(columns)) == rows(derived.select(columns))
    assert fact_transactions(tpch.sales_lines(spark, folder)).count() == 6000
