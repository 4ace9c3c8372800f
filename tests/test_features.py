from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import product

import pandas as pd
from pyspark.sql import functions as F

from oracles.sql import SCORE_CODES
from tests.conftest import rows
from tillgrain.operators import features
from tillgrain.operators.rfm import LAST_SEGMENT, SEGMENT_RULES, assign_segment


def test_datetime_parts(make_sales):
    lines = make_sales(
        ("1", "A", "a", 1, "2011-12-31 23:59", 1, 1, "UK"),  # a Saturday
        ("2", "A", "a", 1, "2011-01-03 00:00", 1, 1, "UK"),  # a Monday
    )
    got = features.datetime_features(lines).select(
        "Year", "Month", "Day", "Hour", "DayOfWeek", "IsWeekend", "Quarter"
    )
    assert rows(got) == [(2011, 1, 3, 0, 0, 0, 1), (2011, 12, 31, 23, 5, 1, 4)]


def test_price_bands_are_right_closed(make_sales):
    prices = [0, 0.01, 1, 1.01, 5, 10, 50, 1000, 1000.01]
    lines = make_sales(*[(str(i), "A", "a", 1, "2011-01-01 00:00", p, 1, "UK") for i, p in enumerate(prices)])
    got = [
        r[0]
        for r in features.price_features(lines)
        .orderBy(F.col("InvoiceNo").cast("int"))
        .select("PricePerUnit_Binned")
        .collect()
    ]
    assert got == [None, "Very Low", "Very Low", "Low", "Low", "Medium", "High", "Premium", None]


def test_lifetime_counts_full_days(make_sales):
    lines = make_sales(
        ("1", "A", "a", 2, "2011-01-01 22:00", 1, 1, "UK"),
        ("2", "B", "b", 4, "2011-01-02 01:00", 2, 1, "UK"),
    )
    got = features.customer_stats(features.revenue_invoices(lines)).first()
    assert (got.CustomerLifetimeDays, got.TotalOrders, got.TotalItems) == (0, 2, 6)
    assert (got.AvgOrderValue, got.AvgItemsPerOrder) == (5.0, 3.0)


def test_days_since_previous_order_match_pandas(spark):
    """Ties at one instant, many orders on one day, gaps, and one customer with most orders."""
    rng = random.Random(3)
    start = datetime(2011, 1, 1)
    orders = []
    for i in range(600):
        customer = 1 if rng.random() < 0.5 else rng.randrange(2, 30)
        minute = rng.choice([0, 0, 5, 700, 1439])
        orders.append((i, customer, start + timedelta(days=rng.randrange(0, 60), minutes=minute)))
    pdf = pd.DataFrame(orders, columns=["InvoiceNo", "CustomerID", "OrderDate"])
    pdf = pdf.sort_values(["CustomerID", "OrderDate", "InvoiceNo"])
    pdf["gap"] = pdf.groupby("CustomerID")["OrderDate"].diff().dt.days
    want = {r.InvoiceNo: None if pd.isna(r.gap) else int(r.gap) for r in pdf.itertuples()}
    df = spark.createDataFrame(orders, "InvoiceNo bigint, CustomerID bigint, OrderDate timestamp_ntz")
    got = {r.InvoiceNo: r.DaysSinceLastOrder for r in features.days_since_previous_order(df).collect()}
    assert got == want


def test_order_and_product_features(make_sales):
    lines = make_sales(
        ("1", "A", "a", 2, "2011-01-01 08:00", 1, 1, "UK"),
        ("1", "A", "a", 1, "2011-01-01 08:00", 1, 1, "UK"),
        ("1", "B", "b", 1, "2011-01-01 08:00", 3, 1, "UK"),
        ("2", "A", "a", 5, "2011-01-04 07:00", 2, 1, "UK"),
        ("3", "A", "a", 5, "2011-01-04 07:00", 2, 2, "FR"),
    )
    orders = features.order_stats(lines).select("InvoiceNo", "OrderTotalQty", "BasketSize", "DaysSinceLastOrder")
    assert rows(orders) == [("1", 4, 2, None), ("2", 5, 1, 2), ("3", 5, 1, None)]
    products = features.product_stats(lines).select(
        "StockCode", "ProductUniqueCustomers", "ProductTransactions", "AvgProductPrice", "ProductPopularity"
    )
    assert rows(products) == [("A", 2, 3, 1.5, 1.0), ("B", 1, 1, 3.0, 0.5)]


def test_country_frequency_and_home_flag(make_sales):
    lines = make_sales(
        ("1", "A", "a", 2, "2011-01-01 08:00", 1, 1, "United Kingdom"),
        ("1", "B", "a", 2, "2011-01-01 08:00", 1, 1, "United Kingdom"),
        ("2", "A", "a", 2, "2011-01-01 08:00", 1, 2, "France"),
    )
    got = features.geographic_features(lines).select("Country", "IsUK", "CountryFreq").distinct()
    assert rows(got) == [("France", 0, 1), ("United Kingdom", 1, 2)]


def test_engineered_table_keeps_every_line(make_sales):
    lines = make_sales(
        *[(str(i % 7), f"P{i % 5}", "x", i + 1, f"2011-0{1 + i % 7}-01 08:00", 2, i % 7, "UK") for i in range(40)]
    )
    table = features.engineered_sales(lines)
    assert table.count() == 40
    expected = {"Hour", "Revenue", "TotalSpend", "CustomerSegment", "BasketSize", "ProductPopularity", "CountryFreq"}
    assert expected <= set(table.columns)


def test_score_features_on_lines(make_sales):
    lines = make_sales(
        *[(str(i), "A", "a", 1 + i, f"2011-01-{1 + i:02d} 08:00", 2, i, "UK") for i in range(5)],
        ("9", "A", "a", 1, "2011-01-20 08:00", 2, 4, "UK"),
    )
    got = features.rfm_features(lines).select("InvoiceNo", "CustomerID", "Recency", "RFM_Score", "CustomerSegment")
    assert rows(got) == [
        ("0", 0, 20, "111", "Others"),
        ("1", 1, 19, "222", "Others"),
        ("2", 2, 18, "333", "Others"),
        ("3", 3, 17, "444", "Loyal Customers"),
        ("4", 4, 1, "555", "Champions"),
        ("9", 4, 1, "555", "Champions"),
    ]


def _all_triples(spark):
    triples = list(product(range(1, 6), repeat=3))
    return triples, spark.createDataFrame(triples, "r int, f int, m int")


def test_rule_segments_over_all_scores(spark):
    triples, df = _all_triples(spark)

    def by_table(r, f, m):
        for name, rs, fs, ms in SEGMENT_RULES:
            if rs[0] <= r <= rs[1] and fs[0] <= f <= fs[1] and ms[0] <= m <= ms[1]:
                return name
        return LAST_SEGMENT

    got = {tuple(r[:3]): r[3] for r in df.withColumn("s", assign_segment(F.col("r"), F.col("f"), F.col("m"))).collect()}
    assert got == {t: by_table(*t) for t in triples}
    sizes = pd.Series(list(got.values())).value_counts().to_dict()
    assert sizes == {
        "Champions": 20, "Loyal Customers": 40, "Potential Loyalists": 30,
        "Hibernating": 20, "At Risk": 9, "Lost": 6,
    }


def test_code_segments_over_all_scores(spark):
    triples, df = _all_triples(spark)
    code = F.concat(*[F.col(c).cast("string") for c in "rfm"])
    got = {r[0]: r[1] for r in df.select(code.alias("c"), features.code_segment(code).alias("s")).collect()}
    first = {}
    for name, codes in SCORE_CODES.items():  # the oracle's own copy
        for c in codes:
            first.setdefault(c, name)
    assert got == {"".join(map(str, t)): first.get("".join(map(str, t)), "Others") for t in triples}
    assert got["155"] == "At Risk"
