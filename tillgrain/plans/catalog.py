"""Every analysis bound to the order tables, with thresholds scaled to their amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.config import BasketConfig, CleaningConfig, Ladder, ReportConfig, Step
from tillgrain.functions import sketches
from tillgrain.functions.calendar import month_label
from tillgrain.operators import basket, bucketed, cleaning, cohort, distincts, features, itemsets, quality, rfm
from tillgrain.operators.grains import customer_months
from tillgrain.operators.star import (
    as_published,
    dim_customers,
    dim_date,
    dim_geography,
    dim_products,
    fact_transactions,
    replace_months,
)
from tillgrain.plans import chart_feeds, customer_reports, sales_reports
from tillgrain.session import Scratch, materialize
from tillgrain.sources import tpch
from tillgrain.sources.readers import RFM_REQUIRED, load_lines, load_lines_with_rejects, validate
from tillgrain.sources.versions import Store
from tillgrain.sources.writers import write_csv

Query = Callable[[SparkSession, str], DataFrame]

HOME = "NATION_2"
OUTLIER_FRACTION = 0.99
LAST_COHORT_MONTH = 83
"""The tables span seven years of orders; a cell past them is an error."""
PRICE_EDGES = (0, 1_000, 5_000, 10_000, 50_000, 1_000_000)
PRICE_LABELS = ("Very Low", "Low", "Medium", "High", "Premium")
MINIMUM_ROWS = {
    "fact_transactions": 50_000,
    "dim_customers": 1_000,
    "dim_products": 1_500,
    "dim_date": 2_000,
    "dim_geography": 30,
}
REPORTS = ReportConfig(
    home_market=HOME,
    home_label="Home",
    abroad_label="International",
    clv_tiers=Ladder(
        (
            Step("Platinum", 2_000_000),
            Step("Gold", 1_500_000),
            Step("Silver", 1_000_000),
            Step("Bronze", 500_000),
        ),
        "Standard",
    ),
    reactivation_tiers=Ladder((Step("High", 1_500_000), Step("Medium", 1_000_000)), "Low"),
    product_tiers=Ladder(
        (Step("Hero Product", 3_000_000), Step("Strong Performer", 2_500_000), Step("Solid Contributor", 2_000_000)),
        "Standard",
    ),
    export_tiers=Ladder(
        (Step("Major Export Market", 130_000_000), Step("Established Export", 125_000_000)),
        "Emerging Market",
    ),
)
BASKETS = BasketConfig(
    home_market=None, min_support=0.005, min_confidence=0.05, min_lift=1.0, top_products=50
)
BRAND_BASKETS = BasketConfig(
    home_market=HOME, min_support=0.02, min_confidence=0.05, min_lift=1.0, top_products=20
)
TYPE_BASKETS = BasketConfig(home_market=None, min_support=0.02, min_confidence=0.2, min_lift=0.5)
LONGEST_TYPE_SET = 5

_BASKET_COLUMNS = ("InvoiceNo", "Description", "Quantity", "Country")


def _portable(df: DataFrame) -> DataFrame:
    """Results in types every engine shares: bigint, double, text and date."""

    def portable(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            column = column.cast("bigint")
        elif kind.startswith("decimal"):
            column = column.cast("double")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("array"):
            column = F.array_join(column, ", ")
        return column.alias(name)

    return df.select(*[portable(name, kind) for name, kind in df.dtypes])


def _lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tpch.sales_lines(spark, folder, columns or tpch.ALL_COLUMNS)


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_segments(tpch.invoices(spark, folder))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return dim_customers(_segmented(spark, folder))


def _geography(spark: SparkSession, folder: str) -> DataFrame:
    return dim_geography(tpch.invoices(spark, folder, country=True), HOME)


_PRODUCT_COLUMNS = (
    "StockCode", "Description", "InvoiceDate", "InvoiceNo", "CustomerID", "UnitPrice", "Quantity", "TotalAmount",
)


_FACT_COLUMNS = tuple(c for c in tpch.ALL_COLUMNS if c != "Description")


def _fact(spark: SparkSession, folder: str) -> DataFrame:
    return fact_transactions(_lines(spark, folder, *_FACT_COLUMNS))


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return dim_products(_lines(spark, folder, *_PRODUCT_COLUMNS))


class _LazyStar:
    """The star over the order tables; a table is built when a check first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self._builders = {
            "dim_customers": lambda: _customers(spark, folder),
            "dim_products": lambda: materialize(_products(spark, folder)),
            "dim_date": lambda: materialize(dim_date(tpch.invoices(spark, folder))),
            "dim_geography": lambda: materialize(_geography(spark, folder)),
            "dim_rfm_segments": lambda: rfm.segment_reference(spark),
            "fact_transactions": lambda: _fact(spark, folder),
        }

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._builders:
            raise AttributeError(name)
        table = self._builders[name]()
        setattr(self, name, table)
        return table


def _star(spark: SparkSession, folder: str) -> _LazyStar:
    return _LazyStar(spark, folder)


_CSV_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
_CSV_DATE = "M/d/yyyy H:mm"


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Months of lines that were written as CSV with a header and loaded again."""
    lines = _lines(spark, folder, *_CSV_COLUMNS).withColumn("InvoiceDate", F.date_format("InvoiceDate", _CSV_DATE))
    path = Scratch(spark).folder()
    write_csv(lines, path)
    loaded = load_lines(spark, path, encoding="UTF-8")
    return loaded.groupBy(month_label(F.col("InvoiceDate")).alias("Month")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("InvoiceNo").alias("orders"),
        F.count_distinct("CustomerID").alias("customers"),
        F.sum("TotalAmount").alias("amount"),
    )


def _csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What a load accepts and rejects of the lines as CSV, some spoilt by their order number."""
    lines = _lines(spark, folder, *_CSV_COLUMNS)
    order = F.col("InvoiceNo")
    spoilt = lines.select(
        order,
        F.to_csv(
            F.struct(
                F.when(order % 37 != 0, order).alias("InvoiceNo"),
                "StockCode",
                "Description",
                F.when(order % 41 == 0, F.lit("many")).otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
                F.when(order % 43 == 0, F.lit("31/31/1995")).otherwise(F.date_format("InvoiceDate", _CSV_DATE)).alias("InvoiceDate"),
                "UnitPrice",
                F.col("CustomerID").cast("double").alias("CustomerID"),
                "Country",
            ),
        ).alias("line"),
    )
    short = F.regexp_replace("line", ",[^,]*,[^,]*$", "")
    line = F.when(order % 47 == 0, short).when(order % 53 == 0, F.concat("line", F.lit(",more"))).otherwise(F.col("line"))
    scratch = Scratch(spark)
    path, rejects = scratch.folder(), scratch.folder()
    spoilt.select(line.alias("value")).write.text(path)
    loaded = load_lines_with_rejects(spark, path, rejects, columns=_CSV_COLUMNS, encoding="UTF-8")
    rejected = spark.read.parquet(rejects)
    reasons = rejected.select(F.explode("reasons").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))
    count = lambda frame, outcome: frame.agg(F.count(F.lit(1)).alias("lines")).select(F.lit(outcome).alias("outcome"), "lines")
    whole = loaded.agg(F.count(F.lit(1)).alias("lines"), F.sum("TotalAmount").alias("amount")).select(F.lit("accepted").alias("outcome"), "lines", "amount")
    others = count(rejected, "rejected").unionByName(reasons).withColumn("amount", F.lit(None).cast("double"))
    return whole.withColumn("amount", F.col("amount").cast("double")).unionByName(others)


def _refreshed_star(spark: SparkSession, folder: str) -> DataFrame:
    """Months of a fact that was loaded once and refreshed twice, as the newest version has them.

    The first load has the years before 1998 without the large lines; they come late, those of
    1995 with the second refresh, the others never. 1998 comes first, 1999 and later second.
    """
    lines = _lines(spark, folder, *_FACT_COLUMNS)
    late, year = F.col("Quantity") > 40, F.year("InvoiceDate")
    months = lambda *years: [(y, m) for y in years for m in range(1, 13)]
    store = Store(spark, Scratch(spark).folder())
    for known, touched in (
        (lines.filter(~late & (year < 1998)), months(1995, 1996, 1997)),
        (lines.filter(year <= 1998), months(1998)),
        (lines, months(1995, *range(1999, 2003))),
    ):
        change = store.refresh()
        replace_months(change, fact_transactions(known), touched)
        change.replace("dim_date", as_published(dim_date(known), "dim_date"))
        change.publish()
    rows = spark.createDataFrame(list(store.parts("fact_transactions").items()), "part string, version bigint")
    part = F.concat(F.lit("year="), F.col("year").cast("string"), F.lit("/month="), F.col("month").cast("string"))
    fact = store.table("fact_transactions").groupBy("year", "month").agg(F.count(F.lit(1)).alias("lines"), F.sum("totalamount").alias("amount"))
    days = store.table("dim_date").groupBy("year", "month").agg(F.count(F.lit(1)).alias("days"))
    return fact.withColumn("part", part).join(rows, "part").join(days, ["year", "month"]).drop("part")


def _customer_star(spark: SparkSession, folder: str) -> bucketed.CustomerStar:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucketed.CustomerStar.write(_fact(spark, folder), _customers(spark, folder), Scratch(spark).folder(), buckets)


def _customers_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct customers and products per day, month, quarter, year and in all."""
    lines = _lines(spark, folder, "CustomerID", "InvoiceDate", "StockCode")
    lines = lines.select("CustomerID", F.col("StockCode").cast("string").alias("StockCode"), F.to_date("InvoiceDate").alias("day"))
    products = materialize(lines.select("StockCode").distinct())
    dictionary = materialize(distincts.numbered(products, "StockCode", products.count()))
    customers = materialize(distincts.id_bitmaps(lines, ["day"], "CustomerID"))
    bought = materialize(distincts.id_bitmaps(lines, ["day"], "StockCode", dictionary))
    counted = distincts.period_counts(customers, "day", "customers")
    return counted.join(distincts.period_counts(bought, "day", "products"), ["level", "period"], "left")


def _amount_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of the line amount, and whether sketches of the months come near enough.

    Sketches are random: the bound is three times their error at 99 %.
    """
    lines = _lines(spark, folder, "InvoiceDate", "TotalAmount")
    fractions = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    cents = lines.select(month_label(F.col("InvoiceDate")).alias("month"), (F.col("TotalAmount") * 100).cast("bigint").alias("cents"))
    months = materialize(sketches.sketches(cents, "cents", ["month"]))
    found = sketches.measured_error(cents, "cents", sketches.sketched_quantiles(months, fractions))
    exact = cleaning.exact_quantiles(lines, "TotalAmount", fractions).select("fraction", F.round("threshold", 4).alias("exact"))
    bound = 3 * sketches.rank_error()
    holds = (F.col("error") <= bound).alias("holds")
    return exact.join(found, "fraction").select("fraction", "exact", F.lit(round(bound, 6)).alias("bound"), holds)


def _given_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated, missing and unmatched keys of the given tables."""
    keys = {
        "lineitem": ["l_orderkey", "l_linenumber"],
        "orders": ["o_orderkey"],
        "customer": ["c_custkey"],
        "part": ["p_partkey"],
    }
    links = {
        ("lineitem", "l_orderkey"): ("orders", "o_orderkey"),
        ("lineitem", "l_partkey"): ("part", "p_partkey"),
        ("orders", "o_custkey"): ("customer", "c_custkey"),
    }
    return quality.table_keys({n: tpch.table(spark, folder, n) for n in keys}, keys, links)


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_cells(tpch.invoices(spark, folder))


def _cohort_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.wide(cohort.cohort_counts(_cells(spark, folder)), "Customers", LAST_COHORT_MONTH)


def _retention(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.retention_long(_cells(spark, folder))


def _basket_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, "InvoiceNo", "Description", "Quantity")


def _brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tpch.sales_lines(spark, folder, _BASKET_COLUMNS, item="p_brand")


def _itemsets(spark: SparkSession, folder: str) -> DataFrame:
    found = basket.baskets(_basket_lines(spark, folder), BASKETS)
    return basket.frequent_itemsets(found, BASKETS)


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return basket.association_rules(materialize(_itemsets(spark, folder)), BASKETS)


def _rule_table(rules: DataFrame) -> DataFrame:
    return basket.by_lift(rules).drop("antecedents", "consequents")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return basket.top_pairs(_rules(spark, folder), BASKETS.top_pairs)


def _brand_itemsets(spark: SparkSession, folder: str) -> DataFrame:
    found = basket.baskets(_brand_lines(spark, folder), BRAND_BASKETS)
    return basket.frequent_itemsets(found, BRAND_BASKETS)


def _type_itemsets(spark: SparkSession, folder: str) -> DataFrame:
    lines = tpch.sales_lines(spark, folder, ("InvoiceNo", "Description", "Quantity"), item="p_type")
    items = itemsets.basket_items(lines, TYPE_BASKETS)
    return itemsets.mined_itemsets(items, Scratch(spark), TYPE_BASKETS, LONGEST_TYPE_SET)


def _type_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = materialize(_type_itemsets(spark, folder))
    return _rule_table(itemsets.grown_rules(found, Scratch(spark), TYPE_BASKETS))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return basket.network_edges(_pairs(spark, folder), BASKETS)


def _retention_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    cells = materialize(_cells(spark, folder))
    return chart_feeds.retention_heatmap(cohort.retention_long(cells), cohort.revenue_long(cells))


def _segment_reference(spark: SparkSession, folder: str) -> DataFrame:
    """The reference rows with the customers each segment has."""
    sizes = _customers(spark, folder).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return rfm.segment_reference(spark).join(sizes, "segment", "left")


def _feature_lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    wanted = ("InvoiceNo", "StockCode", "CustomerID", "InvoiceDate", "Quantity", "UnitPrice", *columns)
    return _lines(spark, folder, *wanted)


def _revenue_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """``revenue_invoices``, the lines summed per order before the header is joined."""
    totals = features.revenue_invoices(_lines(spark, folder, "InvoiceNo", "Quantity", "UnitPrice"))
    return totals.join(tpch.headers(spark, folder), "InvoiceNo")


def _new_vs_returning(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct amounts are counted per order before the header is joined; equal headers count once."""
    orders = sales_reports.distinct_amounts(_lines(spark, folder, "InvoiceNo", "TotalAmount"))
    return sales_reports.new_vs_returning_by_amount(
        orders.join(tpch.headers(spark, folder), "InvoiceNo").distinct()
    )


def _quantity_outliers(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder, "TotalAmount")
    limit = materialize(cleaning.exact_quantile(lines, "TotalAmount", OUTLIER_FRACTION))
    above = F.col("TotalAmount") > limit.select("largest_kept").scalar()
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(above).alias("outliers"),
        F.sum(F.when(~above, F.col("TotalAmount"))).alias("kept_amount"),
    ).withColumn("threshold", F.round(limit.select("threshold").scalar(), 4))


_ANALYSES: dict[str, Query] = {
    # sources and cleaning
    "load_sales_lines": lambda s, d: validate(_lines(s, d), RFM_REQUIRED),
    "csv_round_trip": _csv_round_trip,
    "csv_rejects": _csv_rejects,
    # the quantile needs no texts, so they are joined to what is left
    "clean_sales": lambda s, d: tpch.with_texts(
        s, d, cleaning.clean_sales(tpch.raw_lines(s, d, return_flag="R", texts=False), CleaningConfig(quantity_quantile=0.95))
    ),
    "quantity_outliers": _quantity_outliers,
    "amount_quantiles": _amount_quantiles,
    # features
    "datetime_features": lambda s, d: features.datetime_features(
        _lines(s, d, "InvoiceNo", "StockCode", "Quantity", "InvoiceDate")
    ),
    "price_bands": lambda s, d: features.price_features(
        _lines(s, d, "InvoiceNo", "StockCode", "Quantity", "UnitPrice"), PRICE_EDGES, PRICE_LABELS
    ),
    "customer_features": lambda s, d: features.customer_features(_feature_lines(s, d)),
    "product_features": lambda s, d: features.product_features(_feature_lines(s, d)),
    "order_features": lambda s, d: features.order_features(_feature_lines(s, d)),
    "country_frequency": lambda s, d: features.country_frequency(_lines(s, d, "Country")),
    "rfm_code_segments": lambda s, d: features.rfm_code_stats(_revenue_invoices(s, d)),
    "engineered_sales": lambda s, d: features.engineered_sales(
        _feature_lines(s, d, "Country"), HOME, PRICE_EDGES, PRICE_LABELS
    ),
    # recency, frequency, monetary
    "rfm_base": lambda s, d: rfm.rfm_base(tpch.invoices(s, d)),
    "rfm_scores": lambda s, d: rfm.score_rfm(rfm.rfm_base(tpch.invoices(s, d))),
    "rfm_segments": _segmented,
    "rfm_segment_distribution": lambda s, d: rfm.segment_distribution(_segmented(s, d)),
    "rfm_segment_summary": lambda s, d: rfm.segment_summary(_segmented(s, d)),
    "rfm_insights": lambda s, d: rfm.rfm_insights(rfm.segment_summary(_segmented(s, d))),
    "rfm_score_balance": lambda s, d: quality.score_balance(_customers(s, d)),
    # cohorts
    "cohort_assignments": lambda s, d: cohort.assign_cohorts(
        _lines(s, d, "InvoiceNo", "CustomerID", "InvoiceDate", "TotalAmount")
    ),
    "cohort_extent": lambda s, d: cohort.cohort_extent(_cells(s, d)),
    "cohort_counts": _cohort_counts,
    "cohort_retention_long": _retention,
    "cohort_retention_matrix": lambda s, d: cohort.retention_matrix(_cells(s, d), LAST_COHORT_MONTH),
    "cohort_revenue_long": lambda s, d: cohort.revenue_long(_cells(s, d)),
    "cohort_revenue_matrix": lambda s, d: cohort.revenue_matrix(_cells(s, d), LAST_COHORT_MONTH),
    "cohort_summary": lambda s, d: cohort.cohort_summary(_retention(s, d)),
    "cohort_best_worst": lambda s, d: cohort.best_and_worst(cohort.cohort_summary(_retention(s, d))),
    # baskets
    "basket_lines": lambda s, d: basket.basket_lines(_brand_lines(s, d), BRAND_BASKETS),
    "baskets": lambda s, d: basket.baskets(_basket_lines(s, d), BASKETS),
    "basket_density": lambda s, d: basket.basket_density(basket.baskets(_basket_lines(s, d), BASKETS)),
    "frequent_itemsets": _itemsets,
    "frequent_brand_itemsets": _brand_itemsets,
    "association_rules": lambda s, d: _rule_table(_rules(s, d)),
    "brand_association_rules": lambda s, d: _rule_table(
        basket.association_rules(materialize(_brand_itemsets(s, d)), BRAND_BASKETS)
    ),
    "long_itemsets": _type_itemsets,
    "long_association_rules": _type_rules,
    "rule_strength_counts": lambda s, d: basket.rule_strength_counts(_rules(s, d)),
    "top_product_pairs": _pairs,
    # star schema and its checks
    "rfm_segment_reference": _segment_reference,
    "dim_customers": _customers,
    "dim_products": _products,
    "dim_date": lambda s, d: dim_date(tpch.invoices(s, d)),
    "dim_geography": _geography,
    "fact_transactions": _fact,
    "star_refreshed_twice": _refreshed_star,
    "star_row_counts": lambda s, d: quality.row_counts(_star(s, d)),
    "dq_row_counts": lambda s, d: quality.expected_row_counts(
        quality.row_counts(_star(s, d)), MINIMUM_ROWS
    ),
    "dq_foreign_keys": lambda s, d: quality.foreign_keys(_star(s, d)),
    "dq_primary_keys": lambda s, d: quality.primary_keys(_star(s, d)),
    "dq_given_keys": _given_keys,
    "dq_checks": lambda s, d: quality.value_rules(_star(s, d)),
    "bucketed_segment_revenue": lambda s, d: bucketed.segment_revenue(_customer_star(s, d)),
    "bucketed_champions": lambda s, d: bucketed.champions_deep_dive(_customer_star(s, d)),
    "distinct_by_period": _customers_by_period,
    "verify_segment_revenue": lambda s, d: quality.segment_revenue(_fact(s, d), _customers(s, d)),
    "verify_top_customers": lambda s, d: quality.top_spenders(_customers(s, d)),
    "verify_top_countries": lambda s, d: quality.top_countries(_geography(s, d)),
    # customer reports
    "segment_overview": lambda s, d: customer_reports.segment_overview(
        _customers(s, d), rfm.segment_reference(s)
    ),
    "segment_overview_per_customer": lambda s, d: customer_reports.segment_overview_per_customer(
        _customers(s, d), rfm.segment_reference(s)
    ),
    "top_customers": lambda s, d: customer_reports.top_customers(_customers(s, d), REPORTS),
    "champions_deep_dive": lambda s, d: customer_reports.champions_deep_dive(
        _customers(s, d), _lines(s, d, "CustomerID", "StockCode", "InvoiceDate")
    ),
    "winback_list": lambda s, d: customer_reports.winback_list(
        _customers(s, d), rfm.segment_reference(s)
    ),
    "reactivation_list": lambda s, d: customer_reports.reactivation_list(_customers(s, d), REPORTS),
    "nurture_pipeline": lambda s, d: customer_reports.nurture_list(_customers(s, d), REPORTS),
    "retention_mom": lambda s, d: customer_reports.retention_mom(
        customer_months(tpch.invoices(s, d))
    ),
    "rfm_score_distribution": lambda s, d: customer_reports.rfm_score_distribution(_customers(s, d)),
    "clv_tiers": lambda s, d: customer_reports.clv_tiers(_customers(s, d), REPORTS),
    "segment_migration": lambda s, d: customer_reports.segment_migration(_customers(s, d)),
    # sales reports
    "monthly_revenue": lambda s, d: sales_reports.monthly_revenue(tpch.invoices(s, d)),
    "quarterly_revenue": lambda s, d: sales_reports.quarterly_revenue(tpch.invoices(s, d)),
    "dow_pattern": lambda s, d: sales_reports.dow_pattern(tpch.invoices(s, d)),
    "seasonality_index": lambda s, d: sales_reports.seasonality_index(tpch.invoices(s, d)),
    "country_ranking": lambda s, d: sales_reports.country_ranking(_geography(s, d), REPORTS),
    "top_products": lambda s, d: sales_reports.top_products(_products(s, d), REPORTS),
    "aov_trend": lambda s, d: sales_reports.aov_trend(tpch.invoices(s, d)),
    "home_vs_international": lambda s, d: sales_reports.home_vs_international(
        tpch.invoices(s, d, country=True), REPORTS
    ),
    "new_vs_returning": _new_vs_returning,
    "new_vs_returning_by_order": lambda s, d: sales_reports.new_vs_returning_by_order(
        tpch.invoices(s, d)
    ),
    "exec_summary": lambda s, d: sales_reports.exec_summary(
        tpch.invoices(s, d, country=True), _lines(s, d, "StockCode"), _customers(s, d)
    ),
    # chart feeds
    "rfm_scatter": lambda s, d: chart_feeds.rfm_scatter(_customers(s, d)),
    "rfm_heatmap": lambda s, d: chart_feeds.rfm_heatmap(_customers(s, d)),
    "retention_heatmap": _retention_heatmap,
    "retention_curves": lambda s, d: chart_feeds.retention_curves(_retention(s, d)),
    "retention_average_curve": lambda s, d: cohort.average_curve(_retention(s, d)),
    "rule_scatter": lambda s, d: basket.sample_rules(_rules(s, d), BASKETS),
    "rule_pair_bars": lambda s, d: basket.pair_bars(_pairs(s, d), BASKETS),
    "rule_network_edges": _edges,
    "rule_network_nodes": lambda s, d: basket.network_nodes(_edges(s, d)),
}


def _shared(analysis: Query) -> Query:
    return lambda spark, folder: _portable(analysis(spark, folder))


QUERIES: dict[str, Query] = {name: _shared(analysis) for name, analysis in _ANALYSES.items()}
