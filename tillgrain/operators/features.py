"""Row, customer, product, order and geography features of invoice lines.

Per-key statistics are aggregated, written, and joined back as one row per key. Reading them
from a table matters twice: Spark knows their size and broadcasts only what is small, and both
sides of a larger join come straight from a shuffle, which is what lets adaptive execution
split a hot key on the line side. A join directly onto an aggregation is never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.config import PRICE_EDGES, PRICE_LABELS, RfmConfig
from tillgrain.functions import calendar as cal
from tillgrain.functions.banding import between_edges, first_match
from tillgrain.functions.numeric import ratio
from tillgrain.operators.grains import invoice_grain, order_count, totals_and_distincts
from tillgrain.operators.rfm import rfm_base, score_rfm
from tillgrain.session import materialize
from tillgrain.sources.schemas import AMOUNT

# Three-digit scores that name a segment, first list wins.
SCORE_CODES = {
    "Champions": ["555", "554", "544", "545", "454", "455", "445"],
    "Loyal Customers": ["543", "444", "435", "355", "354", "345", "344", "335"],
    "New Customers": ["512", "511", "422", "421", "412", "411", "311"],
    "At Risk": ["155", "154", "144", "214", "215", "115", "114"],
    "Cannot Lose Them": [
        "155", "254", "245", "253", "252", "243", "242", "235", "234", "225",
        "224", "153", "152", "145", "143", "142", "135", "134", "125", "124",
    ],
    "Price Sensitive": ["331", "321", "231", "241", "251"],
}
OTHER_CODES = "Others"


def datetime_features(lines: DataFrame) -> DataFrame:
    when = F.col("InvoiceDate")
    return lines.withColumns(
        {
            "Year": F.year(when),
            "Month": F.month(when),
            "Day": F.dayofmonth(when),
            "Hour": F.hour(when),
            "DayOfWeek": cal.weekday(when),
            "IsWeekend": cal.weekend_flag(when),
            "Quarter": F.quarter(when),
        }
    )


def price_features(
    lines: DataFrame,
    edges: tuple[float, ...] = PRICE_EDGES,
    labels: tuple[str, ...] = PRICE_LABELS,
) -> DataFrame:
    return lines.withColumns(
        {
            "Revenue": (F.col("Quantity") * F.col("UnitPrice")).cast(AMOUNT),
            "PricePerUnit_Binned": between_edges(F.col("UnitPrice"), edges, labels),
        }
    )


def _with_revenue(lines: DataFrame) -> DataFrame:
    if "Revenue" in lines.columns:
        return lines
    return lines.withColumn("Revenue", (F.col("Quantity") * F.col("UnitPrice")).cast(AMOUNT))


def revenue_invoices(lines: DataFrame) -> DataFrame:
    """The invoice grain with the amount taken as quantity times price."""
    keys = [c for c in ("InvoiceNo", "CustomerID", "InvoiceDate", "Country") if c in lines.columns]
    return invoice_grain(
        _with_revenue(lines).select(*keys, "Quantity", F.col("Revenue").alias("TotalAmount"))
    )


def customer_stats(invoices: DataFrame) -> DataFrame:
    """Orders, items, spend and lifetime of each customer, from the invoice grain."""
    return (
        invoices.filter(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(
            order_count(invoices).alias("TotalOrders"),
            F.sum("Quantity").alias("TotalItems"),
            F.sum("Amount").alias("TotalSpend"),
            F.min("InvoiceDate").alias("FirstPurchase"),
            F.max("InvoiceDate").alias("LastPurchase"),
        )
        .withColumns(_customer_ratios())
    )


def _customer_ratios() -> dict[str, Column]:
    return {
        "CustomerLifetimeDays": cal.whole_days(F.col("FirstPurchase"), F.col("LastPurchase")),
        "AvgOrderValue": ratio(F.col("TotalSpend"), F.col("TotalOrders")),
        "AvgItemsPerOrder": ratio(F.col("TotalItems"), F.col("TotalOrders")),
    }


def customer_features(lines: DataFrame) -> DataFrame:
    lines = materialize(lines)
    stats = materialize(customer_stats(revenue_invoices(lines)))
    return lines.join(stats, "CustomerID", "left")


def code_segment(score: Column) -> Column:
    return first_match(
        [(score.isin(codes), name) for name, codes in SCORE_CODES.items()], OTHER_CODES
    )


def rfm_code_stats(invoices: DataFrame, config: RfmConfig = RfmConfig()) -> DataFrame:
    """Scores of each customer with the segment named by score code, from the invoice grain."""
    scored = score_rfm(rfm_base(invoices, config), config)
    return scored.select(
        "CustomerID",
        "Recency",
        "Frequency",
        "Monetary",
        "R_Score",
        "F_Score",
        "M_Score",
        "RFM_Score",
        code_segment(F.col("RFM_Score")).alias("CustomerSegment"),
    )


#: what customers bring to the lines in :func:`engineered_sales`
CUSTOMER_COLUMNS = (
    "TotalOrders", "TotalItems", "TotalSpend", "FirstPurchase", "LastPurchase",
    "CustomerLifetimeDays", "AvgOrderValue", "AvgItemsPerOrder", "Recency", "Frequency", "Monetary",
    "R_Score", "F_Score", "M_Score", "RFM_Score", "CustomerSegment",
)


def _customer_core(invoices: DataFrame, config: RfmConfig) -> DataFrame:
    """What the columns of customers follow from: the figures of ``customer_stats`` and the scores.

    Both have one grain, so one aggregation serves them.
    """
    figures = [F.sum("Quantity").alias("TotalItems"), F.min("InvoiceDate").alias("FirstPurchase")]
    return score_rfm(rfm_base(invoices, config, figures), config).select(
        "CustomerID",
        F.col("Frequency").alias("TotalOrders"),
        "TotalItems",
        F.col("Monetary").alias("TotalSpend"),
        "FirstPurchase",
        F.col("LastPurchaseDate").alias("LastPurchase"),
        "Recency",
        "R_Score",
        "F_Score",
        "M_Score",
    )


def _customer_codes() -> dict[str, Column]:
    """Columns that repeat or name others; null where the line has no customer."""
    score = F.concat(*[F.col(f"{m}_Score").cast("string") for m in ("R", "F", "M")])
    return {
        "Frequency": F.col("TotalOrders"),
        "Monetary": F.col("TotalSpend"),
        "RFM_Score": score,
        "CustomerSegment": F.when(F.col("R_Score").isNotNull(), code_segment(score)),
    }


def rfm_features(lines: DataFrame, config: RfmConfig = RfmConfig()) -> DataFrame:
    return lines.join(rfm_code_stats(revenue_invoices(lines), config), "CustomerID", "left")


def product_stats(lines: DataFrame) -> DataFrame:
    """Volume, reach and popularity (reach relative to the widest-reaching product)."""
    stats, widest = _product_core(lines)
    return stats.withColumn(
        "ProductPopularity", ratio(F.col("ProductUniqueCustomers"), widest)
    )


def _product_core(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Volume and reach of each product as a written table, and the widest reach."""
    stats = materialize(
        totals_and_distincts(
            _with_revenue(lines),
            "StockCode",
            [
                F.sum(F.col("Quantity").cast("bigint")).alias("ProductTotalQty"),
                F.sum("Revenue").alias("ProductTotalRevenue"),
                ratio(F.sum("UnitPrice"), F.count("UnitPrice")).alias("AvgProductPrice"),
            ],
            [
                F.countDistinct("CustomerID").alias("ProductUniqueCustomers"),
                F.countDistinct("InvoiceNo").alias("ProductTransactions"),
            ],
        )
    )
    return stats, stats.agg(F.max("ProductUniqueCustomers")).scalar()


def product_features(lines: DataFrame) -> DataFrame:
    lines = materialize(lines)
    return lines.join(product_stats(lines), "StockCode", "left")


def days_since_previous_order(orders: DataFrame) -> DataFrame:
    """Whole days from the customer's previous order; null for the first.

    ``orders`` has one row per InvoiceNo with CustomerID and OrderDate. Orders of one customer
    at the same instant collapse into one row before the window (the lowest number counts as
    the first, the others follow it after zero days). The remaining instants are compared
    within each day, and the days through their last instants, so that no window holds more
    than one day of a customer, or one row per day.
    """
    instants = (
        orders.groupBy("CustomerID", "OrderDate")
        .agg(F.min("InvoiceNo").alias("_first"))
        .withColumn("_day", F.to_date("OrderDate"))
    )
    in_day = Window.partitionBy("CustomerID", "_day").orderBy("OrderDate")
    over_days = Window.partitionBy("CustomerID").orderBy("_day")
    days = (
        instants.groupBy("CustomerID", "_day")
        .agg(F.max("OrderDate").alias("_end"))
        .withColumn("_end_before", F.lag("_end").over(over_days))
        .drop("_end")
    )
    gaps = (
        instants.withColumn("_same_day", F.lag("OrderDate").over(in_day))
        .join(days, ["CustomerID", "_day"])
        .select(
            "CustomerID",
            "OrderDate",
            "_first",
            cal.whole_days(F.coalesce("_same_day", "_end_before"), F.col("OrderDate")).alias("_gap"),
        )
    )
    gap = F.when(F.col("InvoiceNo") == F.col("_first"), F.col("_gap")).otherwise(0)
    return orders.join(gaps, ["CustomerID", "OrderDate"]).select(
        *orders.columns, gap.cast("int").alias("DaysSinceLastOrder")
    )


def order_stats(lines: DataFrame) -> DataFrame:
    """Size of each order and the days since the customer's previous one."""
    orders = totals_and_distincts(
        _with_revenue(lines).filter(F.col("CustomerID").isNotNull()),
        "InvoiceNo",
        [
            F.sum(F.col("Quantity").cast("bigint")).alias("OrderTotalQty"),
            F.sum("Revenue").alias("OrderTotalRevenue"),
            F.min("CustomerID").alias("CustomerID"),
            F.min("InvoiceDate").alias("OrderDate"),
        ],
        [F.countDistinct("StockCode").alias("BasketSize")],
    )
    return days_since_previous_order(materialize(orders))


def order_features(lines: DataFrame) -> DataFrame:
    lines = materialize(lines)
    stats = materialize(order_stats(lines).drop("CustomerID", "OrderDate"))
    return lines.join(stats, "InvoiceNo", "left")


def country_frequency(lines: DataFrame) -> DataFrame:
    """Rows per country."""
    return _frequency(lines, F.count(F.lit(1)))


def _frequency(rows: DataFrame, size: Column) -> DataFrame:
    return (
        rows.filter(F.col("Country").isNotNull()).groupBy("Country").agg(size.alias("CountryFreq"))
    )


def home_flag(lines: DataFrame, home_market: str) -> DataFrame:
    is_home = F.coalesce((F.col("Country") == home_market).cast("int"), F.lit(0))
    return lines.withColumn("IsUK", is_home)


def geographic_features(lines: DataFrame, home_market: str = "United Kingdom") -> DataFrame:
    """Home flag and country frequency; the written lookup is tiny, so it is broadcast."""
    lookup = materialize(country_frequency(lines))
    return home_flag(lines, home_market).join(lookup, "Country", "left")


def engineered_sales(
    lines: DataFrame,
    home_market: str = "United Kingdom",
    price_edges: tuple[float, ...] = PRICE_EDGES,
    price_labels: tuple[str, ...] = PRICE_LABELS,
    rfm: RfmConfig = RfmConfig(),
) -> DataFrame:
    """All features on one table.

    The lines, which may be a join, are written once and everything is taken from there.
    Customer, score and country features come from one written invoice grain. Customer, score
    and order features are attached to the pairs of invoice and customer first, so that the
    lines are shuffled once for all of them. All of a customer's figures are one written table,
    so that the pairs of a hot customer can be split.

    The lines meet the few product figures first, while they are narrow, and what follows from
    a row alone is added behind the last join, so that no shuffle carries it.
    """
    lines = materialize(lines)

    def of_row(rows: DataFrame) -> DataFrame:
        rows = rows.transform(datetime_features).transform(price_features, price_edges, price_labels)
        return home_flag(rows, home_market)

    base = of_row(lines)
    invoices = materialize(revenue_invoices(base))
    orders = materialize(order_stats(base).drop("CustomerID", "OrderDate"))
    pairs = (
        materialize(invoices.select("InvoiceNo", "CustomerID").distinct())
        .join(materialize(_customer_core(invoices, rfm)), "CustomerID", "left")
        .join(orders, "InvoiceNo", "left")
    )
    products, widest = _product_core(base)
    joined = (
        lines.join(products, "StockCode", "left")
        .join(materialize(pairs), ["InvoiceNo", "CustomerID"], "left")
        .join(materialize(_frequency(invoices, F.sum("Lines"))), "Country", "left")
    )
    keys = ["StockCode", "InvoiceNo", "CustomerID", "Country"]
    return (
        of_row(joined)
        .withColumns(_customer_ratios())
        .withColumns(_customer_codes())
        .withColumn("ProductPopularity", ratio(F.col("ProductUniqueCustomers"), widest))
        .select(
            *keys,
            *[c for c in base.columns if c not in keys],
            "CountryFreq",
            *CUSTOMER_COLUMNS,
            *[c for c in orders.columns if c not in keys],
            *[c for c in products.columns if c not in keys],
            "ProductPopularity",
        )
    )
