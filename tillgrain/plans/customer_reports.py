"""Customer reports over the customer dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tillgrain.config import ReportConfig
from tillgrain.functions import calendar as cal
from tillgrain.functions.banding import at_least, at_most, first_match
from tillgrain.functions.numeric import percent, ratio, rounded
from tillgrain.operators.grains import totals_and_distincts
from tillgrain.session import materialize

# Segments by the campaign they belong to.
WIN_BACK = ("At Risk", "Cannot Lose Them")
NURTURE = ("New Customers", "Promising", "Potential Loyalists")
TOP_SEGMENTS = ("Champions", "Loyal Customers")

# What moves a segment up.
UPGRADE_PATHS = {
    "Potential Loyalists": "One more order → Loyal Customer",
    "Promising": "Two more orders → Potential Loyalist",
    "At Risk": "Recent purchase → Loyal Customer",
    "Hibernating": "Any purchase → Promising/New Customer",
    "New Customers": "Second purchase → Potential Loyalist",
}
NO_UPGRADE = "Already in top segment"


def _whole() -> WindowSpec:
    """All rows of a finished, small aggregate."""
    return Window.partitionBy()


def _iso(day: str):
    return F.col(day).cast("date").cast("string")


def with_line_counts(customers: DataFrame, fact: DataFrame) -> DataFrame:
    """Attach the number of fact rows to a customer dimension that lacks it."""
    counts = fact.groupBy("customerid").agg(F.count(F.lit(1)).alias("lines"))
    return customers.join(counts, "customerid")


def _overview(customers: DataFrame, reference: DataFrame, weight) -> DataFrame:
    total = F.sum("_weight")

    def mean(column: str):
        return F.sum(F.col(column) * F.col("_weight"))

    return (
        customers.withColumn("_weight", weight.cast("bigint"))
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("_customers"),
            F.sum("monetary").alias("_revenue"),
            total.alias("_weights"),
            mean("monetary").alias("_spend"),
            mean("recency").alias("_days"),
            mean("frequency").alias("_orders"),
        )
        .join(F.broadcast(reference.select("segment", "marketingaction", "priority")), "segment")
        .withColumns(
            {
                "_all": F.sum("_customers").over(_whole()),
                "_all_revenue": F.sum("_revenue").over(_whole()),
            }
        )
        .orderBy("priority")
        .select(
            F.col("segment").alias("Segment"),
            F.col("_customers").alias("Customers"),
            percent(F.col("_customers"), F.col("_all"), 1).alias("Customer_%"),
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            percent(F.col("_revenue"), F.col("_all_revenue"), 1).alias("Revenue_%"),
            rounded(ratio(F.col("_spend"), F.col("_weights")), 0).alias("Avg_Lifetime_Spend"),
            rounded(ratio(F.col("_days"), F.col("_weights")), 0).alias("Avg_Days_Since_Purchase"),
            rounded(ratio(F.col("_orders"), F.col("_weights")), 1).alias("Avg_Orders"),
            F.col("marketingaction").alias("Recommended_Action"),
        )
    )


def segment_overview(customers: DataFrame, reference: DataFrame) -> DataFrame:
    """Segments with averages weighted by line count, as a join to the fact would give them.

    The count per customer replaces that join: the result is the same without touching lines.
    """
    return _overview(customers, reference, F.col("lines"))


def segment_overview_per_customer(customers: DataFrame, reference: DataFrame) -> DataFrame:
    """The same figures with every customer counted once."""
    return _overview(customers, reference, F.lit(1))


def top_customers(customers: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    return (
        customers.orderBy(F.desc("monetary"), "customerid")
        .limit(config.top_n)
        .select(
            F.col("customerid").alias("CustomerID"),
            F.col("segment").alias("Segment"),
            rounded(F.col("monetary"), 2).alias("Lifetime_Spend_GBP"),
            F.col("frequency").alias("Total_Orders"),
            rounded(F.col("avgordervalue"), 2).alias("Avg_Order_Value_GBP"),
            F.col("recency").alias("Days_Since_Last_Purchase"),
            F.col("r_score").alias("R_Score"),
            F.col("f_score").alias("F_Score"),
            F.col("m_score").alias("M_Score"),
            F.col("rfm_total").alias("RFM_Total"),
            _iso("lastpurchasedate").alias("Last_Purchase_Date"),
            at_most(F.col("recency"), config.activity_status).alias("Activity_Status"),
        )
        .orderBy(F.desc("Lifetime_Spend_GBP"), "CustomerID")
    )


def champions_deep_dive(customers: DataFrame, lines: DataFrame) -> DataFrame:
    """Breadth and span of what champions buy.

    Only the lines of champions are counted. Lines are aggregated before the last join: a
    customer with very many lines is reduced on the map side, and the join is one row to one row.
    """
    champions = materialize(
        customers.filter(F.col("segment") == "Champions").select(F.col("customerid").alias("CustomerID"))
    )
    activity = totals_and_distincts(
        materialize(lines.join(champions, "CustomerID", "left_semi")),
        "CustomerID",
        [
            F.min("InvoiceDate").alias("first_purchase"),
            F.max("InvoiceDate").alias("last_purchase"),
        ],
        [
            F.countDistinct("StockCode").alias("unique_products_bought"),
            F.countDistinct(cal.month_index(F.col("InvoiceDate"))).alias("active_months"),
        ],
    )
    return (
        customers.filter(F.col("segment") == "Champions")
        .join(activity.withColumnRenamed("CustomerID", "customerid"), "customerid")
        .orderBy(F.desc("monetary"), "customerid")
        .select(
            "customerid",
            rounded(F.col("monetary"), 2).alias("lifetime_spend"),
            F.col("frequency").alias("total_orders"),
            rounded(F.col("avgordervalue"), 2).alias("avg_order_value"),
            F.col("recency").alias("days_since_purchase"),
            "unique_products_bought",
            "active_months",
            "first_purchase",
            "last_purchase",
        )
    )


def winback_list(customers: DataFrame, reference: DataFrame) -> DataFrame:
    """Customers going cold, most valuable first, with the revenue they stand for."""
    at_risk = F.col("avgordervalue").cast("double") * F.col("frequency")
    return (
        customers.filter(F.col("segment").isin(*WIN_BACK))
        .join(F.broadcast(reference.select("segment", "marketingaction")), "segment")  # nine rows
        .orderBy(F.desc("monetary"), "customerid")
        .select(
            F.col("customerid").alias("CustomerID"),
            F.col("segment").alias("Segment"),
            rounded(F.col("monetary"), 2).alias("Lifetime_Spend_GBP"),
            F.col("frequency").alias("Historical_Orders"),
            F.col("recency").alias("Days_Silent"),
            rounded(F.col("avgordervalue"), 2).alias("Avg_Order_Value_GBP"),
            F.col("r_score").alias("R_Score"),
            F.col("m_score").alias("M_Score"),
            _iso("lastpurchasedate").alias("Last_Seen"),
            rounded(at_risk, 0).alias("Est_Annual_Revenue_At_Risk"),
            F.col("marketingaction").alias("Action"),
        )
    )


def reactivation_list(customers: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    return (
        customers.filter(F.col("segment") == "Hibernating")
        .orderBy(F.desc("monetary"), "customerid")
        .select(
            "customerid",
            rounded(F.col("monetary"), 2).alias("lifetime_spend"),
            F.col("frequency").alias("past_orders"),
            F.col("recency").alias("days_inactive"),
            rounded(F.col("avgordervalue"), 2).alias("avg_order_value"),
            at_least(F.col("monetary"), config.reactivation_tiers).alias("reactivation_tier"),
            F.date_format("lastpurchasedate", "dd MMM yyyy").alias("last_purchase"),
        )
    )


def nurture_list(customers: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    return (
        customers.filter(F.col("segment").isin(*NURTURE))
        .orderBy("recency", "customerid")
        .select(
            "customerid",
            "segment",
            F.col("recency").alias("days_since_first_purchase"),
            F.col("frequency").alias("orders_so_far"),
            rounded(F.col("monetary"), 2).alias("spend_so_far"),
            rounded(F.col("avgordervalue"), 2).alias("avg_order_value"),
            _iso("lastpurchasedate").alias("last_purchase"),
            at_most(F.col("recency"), config.follow_up_urgency).alias("follow_up_urgency"),
        )
    )


def retention_mom(months: DataFrame) -> DataFrame:
    """Customers of each month who also bought in the month before.

    ``months`` has one row per customer and active month, so looking one row back replaces a
    self join. Rates compare with the previous month that has sales; ``gap`` marks the rows
    where that is not the previous calendar month.
    """
    before = F.lag("Month").over(Window.partitionBy("CustomerID").orderBy("Month"))
    by_month = _whole().orderBy("Month")
    previous = F.lag("_active").over(by_month)
    return (
        months.withColumn("_kept", before == F.col("Month") - 1)
        .groupBy("Month")
        .agg(F.count(F.lit(1)).alias("_active"), F.count_if("_kept").alias("_retained"))
        .select(
            cal.label_of_index(F.col("Month")).alias("_label"),
            "_active",
            "_retained",
            percent(F.col("_retained"), previous, 1).alias("_rate"),
            (F.col("_active") - previous).alias("_growth"),
            (F.lag("Month").over(by_month) != F.col("Month") - 1).cast("int").alias("gap"),
        )
        .select(
            F.col("_label").alias("Month"),
            F.col("_active").alias("Active_Customers"),
            F.col("_retained").alias("Retained_from_Prev_Month"),
            F.col("_rate").alias("Retention_Rate_%"),
            F.col("_growth").alias("Customer_Growth"),
            F.coalesce("gap", F.lit(0)).alias("gap"),
        )
        .orderBy("Month")
    )


def rfm_score_distribution(customers: DataFrame) -> DataFrame:
    size = F.col("_n")
    return (
        customers.groupBy("r_score", "f_score", "m_score")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("monetary").alias("_spend"),
            F.sum("recency").alias("_days"),
            F.sum("frequency").alias("_orders"),
        )
        .orderBy(F.desc("r_score"), F.desc("f_score"), F.desc("m_score"))
        .select(
            F.col("r_score").alias("R_Score"),
            F.col("f_score").alias("F_Score"),
            F.col("m_score").alias("M_Score"),
            size.alias("Customers"),
            rounded(ratio(F.col("_spend"), size), 0).alias("Avg_Spend_GBP"),
            rounded(ratio(F.col("_days"), size), 0).alias("Avg_Recency_Days"),
            rounded(ratio(F.col("_orders"), size), 1).alias("Avg_Orders"),
        )
    )


def clv_tiers(customers: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """Customers and revenue per lifetime-value tier, richest tier first."""
    size = F.col("_n")
    return (
        customers.groupBy(at_least(F.col("monetary"), config.clv_tiers).alias("CLV_Tier"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("monetary").alias("_spend"),
            F.sum("frequency").alias("_orders"),
            F.min("monetary").alias("_least"),
        )
        .withColumns(
            {
                "_all": F.sum("_n").over(_whole()),
                "_all_spend": F.sum("_spend").over(_whole()),
            }
        )
        .orderBy(F.desc("_least"))
        .select(
            "CLV_Tier",
            size.alias("Customers"),
            percent(size, F.col("_all"), 1).alias("% of Base"),
            rounded(F.col("_spend"), 0).alias("Total_Revenue_GBP"),
            percent(F.col("_spend"), F.col("_all_spend"), 1).alias("% of Revenue"),
            rounded(ratio(F.col("_spend"), size), 0).alias("Avg_Spend_GBP"),
            rounded(ratio(F.col("_orders"), size), 1).alias("Avg_Orders"),
        )
    )


def segment_migration(customers: DataFrame) -> DataFrame:
    """Segments below the top two, the step that would lift them and what it may bring."""
    path = first_match(
        [(F.col("segment") == name, text) for name, text in UPGRADE_PATHS.items()], NO_UPGRADE
    )
    size = F.col("_n")
    return (
        customers.filter(~F.col("segment").isin(*TOP_SEGMENTS))
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("monetary").alias("_spend"),
            F.sum(F.col("avgordervalue").cast("decimal(18,2)")).alias("_aov"),
        )
        .withColumn("_mean_spend", ratio(F.col("_spend"), size))
        .orderBy(F.desc("_mean_spend"), "segment")
        .select(
            F.col("segment").alias("Current_Segment"),
            path.alias("Path_to_Upgrade"),
            size.alias("Customers"),
            rounded(F.col("_mean_spend"), 0).alias("Avg_Current_Spend"),
            rounded(ratio(F.col("_aov"), size), 0).alias("Avg_Order_Value"),
            rounded(ratio(F.col("_aov") * 2, size), 0).alias("Est_Revenue_If_They_Return"),
        )
    )
