"""Sales reports over the invoice grain.

Calendar attributes follow from the date, so no date dimension is joined. Windows run on the
finished aggregate: one row per month, quarter, weekday or market.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tillgrain.config import ReportConfig
from tillgrain.functions import calendar as cal
from tillgrain.functions.banding import at_least, first_match
from tillgrain.functions.numeric import money, percent, ratio, rounded
from tillgrain.operators.grains import order_count


def _buyers() -> Column:
    return F.countDistinct("CustomerID")


def _revenue() -> Column:
    return F.sum("Amount")


def _date() -> Column:
    return F.col("InvoiceDate")


def _whole() -> WindowSpec:
    """All rows of a finished, small aggregate."""
    return Window.partitionBy()


def _growth(revenue: str, order: str) -> Column:
    before = F.lag(revenue).over(_whole().orderBy(order))
    return percent(F.col(revenue) - before, before, 1)


def _order_value() -> Column:
    return ratio(F.col("_revenue"), F.col("_orders"))


def monthly_revenue(invoices: DataFrame) -> DataFrame:
    """Orders, customers, revenue, growth and running total per month."""
    running = (
        _whole().orderBy("Month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first_day = F.to_date(F.concat(F.col("Month"), F.lit("-01")))
    return (
        invoices.groupBy(cal.month_label(_date()).alias("Month"))
        .agg(
            order_count(invoices).alias("_orders"),
            _buyers().alias("_buyers"),
            _revenue().alias("_revenue"),
            F.sum("Lines").alias("_lines"),
        )
        .select(
            "Month",
            cal.month_name(first_day).alias("Month_Name"),
            F.year(first_day).alias("Year"),
            F.quarter(first_day).alias("Quarter"),
            F.col("_orders").alias("Total_Orders"),
            F.col("_buyers").alias("Unique_Customers"),
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            rounded(ratio(F.col("_revenue"), F.col("_lines")), 2).alias("Avg_Line_Value"),
            rounded(_order_value(), 2).alias("Avg_Order_Value_GBP"),
            _growth("_revenue", "Month").alias("MoM_Growth_%"),
            rounded(F.sum("_revenue").over(running), 0).alias("Cumulative_Revenue_GBP"),
        )
        .orderBy("Month")
    )


def quarterly_revenue(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy(
            cal.quarter_label(_date()).alias("Quarter"),
            F.year(_date()).alias("Year"),
            F.quarter(_date()).alias("Q"),
        )
        .agg(order_count(invoices).alias("_orders"), _buyers().alias("_buyers"), _revenue().alias("_revenue"))
        .select(
            "Quarter",
            "Year",
            "Q",
            F.col("_orders").alias("Total_Orders"),
            F.col("_buyers").alias("Unique_Customers"),
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            rounded(_order_value(), 2).alias("Avg_Order_Value_GBP"),
            _growth("_revenue", "Quarter").alias("QoQ_Growth_%"),
        )
        .orderBy("Quarter")
    )


def dow_pattern(invoices: DataFrame) -> DataFrame:
    """Sales per weekday; the daily average is over the weekdays that occur."""
    return (
        invoices.groupBy(
            cal.weekday(_date()).alias("Day_Number"),
            cal.day_name(_date()).alias("Day"),
            cal.weekend_flag(_date()).alias("Is_Weekend"),
        )
        .agg(order_count(invoices).alias("_orders"), _buyers().alias("_buyers"), _revenue().alias("_revenue"))
        .select(
            "Day_Number",
            "Day",
            "Is_Weekend",
            F.col("_orders").alias("Total_Orders"),
            F.col("_buyers").alias("Unique_Customers"),
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            rounded(
                ratio(F.sum("_revenue").over(_whole()), F.count(F.lit(1)).over(_whole())), 0
            ).alias("Daily_Avg_Revenue"),
            percent(F.col("_revenue"), F.sum("_revenue").over(_whole()), 1).alias(
                "% of Total Revenue"
            ),
            rounded(_order_value(), 2).alias("Avg_Order_Value_GBP"),
        )
        .orderBy("Day_Number")
    )


def seasonality_index(invoices: DataFrame) -> DataFrame:
    """Calendar months with the years pooled; 100 is the mean month."""
    total = F.sum("_revenue").over(_whole())
    mean = ratio(total, F.count(F.lit(1)).over(_whole()))
    return (
        invoices.groupBy(F.month(_date()).alias("Month_Number"), cal.month_name(_date()).alias("Month"))
        .agg(order_count(invoices).alias("_orders"), _revenue().alias("_revenue"), F.sum("Lines").alias("_lines"))
        .select(
            "Month_Number",
            "Month",
            F.col("_orders").alias("Total_Orders"),
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            rounded(ratio(F.col("_revenue"), F.col("_lines")), 2).alias("Avg_Transaction_Value"),
            percent(F.col("_revenue"), total, 1).alias("% of Annual Revenue"),
            percent(F.col("_revenue"), mean, 0).alias("Seasonality_Index"),
        )
        .orderBy("Month_Number")
    )


def country_ranking(geography: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """Countries by revenue with a market class."""
    revenue, aov = F.col("totalrevenue"), F.col("avgordervalue")
    tiers = config.export_tiers
    market = first_match(
        [(F.col("isuk") == 1, "Home Market")]
        + [(revenue >= s.bound, s.label) for s in tiers.steps]
        + [(aov > F.col("_mean_aov"), "Premium Small Market")],
        tiers.otherwise,
    )
    return (
        geography.withColumns(
            {
                "_mean_aov": F.avg("avgordervalue").over(_whole()),
                "_total": F.sum("totalrevenue").over(_whole()),
            }
        )
        .select(
            F.col("country").alias("Country"),
            F.col("isuk").alias("Is_UK"),
            F.col("revenuerank").alias("Revenue_Rank"),
            F.col("totalorders").alias("Total_Orders"),
            F.col("uniquecustomers").alias("Unique_Customers"),
            money(revenue).alias("Total_Revenue_GBP"),
            percent(revenue, F.col("_total"), 2).alias("% of Total Revenue"),
            money(aov).alias("Avg_Order_Value_GBP"),
            rounded(ratio(revenue, F.col("uniquecustomers")), 2).alias("Revenue_per_Customer_GBP"),
            market.alias("Market_Classification"),
        )
        .orderBy("Revenue_Rank", "Country")
    )


def top_products(products: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """Best sellers. The share is of all described products; Spark takes that total first."""
    described = products.filter(F.col("description").isNotNull())
    total = described.agg(F.sum("totalrevenue")).scalar()
    revenue = F.col("totalrevenue")
    return (
        described.orderBy(F.desc("totalrevenue"), "stockcode")
        .limit(config.top_n)
        .select(
            F.col("stockcode").alias("Stock_Code"),
            F.col("description").alias("Product"),
            money(revenue).alias("Total_Revenue_GBP"),
            percent(revenue, total, 2).alias("% of Total Revenue"),
            F.col("totalquantitysold").alias("Units_Sold"),
            money(F.col("avgunitprice")).alias("Avg_Price_GBP"),
            F.col("uniquecustomers").alias("Unique_Buyers"),
            F.col("uniqueinvoices").alias("Invoices_Appeared_In"),
            rounded(F.col("popularityscore") * 100, 1).alias("Popularity_%"),
            at_least(revenue, config.product_tiers).alias("Product_Tier"),
        )
        .orderBy(F.desc("Total_Revenue_GBP"), "Stock_Code")
    )


def aov_trend(invoices: DataFrame) -> DataFrame:
    """Average order value per month, its three-month mean and its distance from the mean."""
    last_three = _whole().orderBy("Month").rowsBetween(-2, Window.currentRow)
    return (
        invoices.groupBy(cal.month_label(_date()).alias("Month"))
        .agg(order_count(invoices).alias("_orders"), _revenue().alias("_revenue"))
        .withColumn("_aov", _order_value())
        .select(
            "Month",
            F.col("_orders").alias("Orders"),
            rounded(F.col("_revenue"), 0).alias("Revenue_GBP"),
            rounded(F.col("_aov"), 2).alias("Avg_Order_Value_GBP"),
            rounded(F.avg("_aov").over(last_three), 2).alias("3M_Rolling_Avg_AOV"),
            rounded(F.col("_aov") - F.avg("_aov").over(_whole()), 2).alias("AOV_vs_Average"),
        )
        .orderBy("Month")
    )


def home_vs_international(invoices: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    is_home = F.col("Country") == config.home_market
    market = F.when(is_home, F.lit(config.home_label)).otherwise(F.lit(config.abroad_label))
    return (
        invoices.filter(F.col("Country").isNotNull())
        .groupBy(market.alias("Market"))
        .agg(order_count(invoices).alias("_orders"), _buyers().alias("_buyers"), _revenue().alias("_revenue"))
        .select(
            "Market",
            F.col("_buyers").alias("Customers"),
            F.col("_orders").alias("Orders"),
            rounded(F.col("_revenue"), 0).alias("Revenue_GBP"),
            percent(F.col("_revenue"), F.sum("_revenue").over(_whole()), 1).alias("% of Revenue"),
            rounded(_order_value(), 2).alias("Avg_Order_Value_GBP"),
            rounded(ratio(F.col("_revenue"), F.col("_buyers")), 2).alias("Revenue_per_Customer_GBP"),
        )
        .orderBy((F.col("Market") == config.home_label).desc())
    )


def _new_and_returning(months: DataFrame) -> DataFrame:
    """Split of monthly totals, given per customer and month: ``_month``, ``_n``, ``_sum`` and the
    amount ``_first_sum`` of the earliest unit of that month.

    A customer is new with the earliest unit of the first month, and returning with the rest.
    The window holds one row per customer and active month.
    """
    is_first = F.col("_month") == F.min("_month").over(Window.partitionBy("CustomerID"))
    split = months.withColumn("_is_first", is_first).groupBy("_month").agg(
        F.count_if("_is_first").alias("_new_n"),
        F.sum(F.when(F.col("_is_first"), F.col("_first_sum"))).alias("_new_sum"),
        F.sum("_n").alias("_all_n"),
        F.sum("_sum").alias("_all_sum"),
    )
    new_sum = F.coalesce("_new_sum", F.lit(0).cast("decimal(28,2)"))
    kinds = F.array(
        F.struct(
            F.lit("New Customer").alias("Customer_Type"),
            F.col("_new_n").alias("Orders"),
            new_sum.cast("decimal(38,2)").alias("_part"),
        ),
        F.struct(
            F.lit("Returning Customer").alias("Customer_Type"),
            (F.col("_all_n") - F.col("_new_n")).alias("Orders"),
            (F.col("_all_sum") - new_sum).cast("decimal(38,2)").alias("_part"),
        ),
    )
    return (
        split.select("_month", "_all_sum", F.inline(kinds))
        .filter(F.col("Orders") > 0)
        .select(
            cal.label_of_index(F.col("_month")).alias("Month"),
            "Customer_Type",
            "Orders",
            rounded(F.col("_part"), 0).alias("Revenue_GBP"),
            percent(F.col("_part"), F.col("_all_sum"), 1).alias("% of Month Revenue"),
        )
        .orderBy("Month", "Customer_Type")
    )


def new_vs_returning(lines: DataFrame) -> DataFrame:
    """New and returning revenue by distinct line amounts.

    Compatible with the published figures: lines of one invoice and instant with equal amounts
    count once, every remaining amount counts as an order, and only the first is new. Ties go
    by time, then invoice, then amount.
    """
    return new_vs_returning_by_amount(distinct_amounts(lines))


def distinct_amounts(lines: DataFrame) -> DataFrame:
    """Number, sum and least of the distinct amounts of each invoice, customer and instant.

    A missing amount is one of them, and the least. ``lines`` without customers and instants
    give a row per invoice, to be joined with its header.
    """
    keys = [c for c in ("CustomerID", "InvoiceNo", "InvoiceDate") if c in lines.columns]
    amount = F.col("TotalAmount")
    return (
        lines.select(*keys, "TotalAmount")
        .distinct()
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_units"),
            F.sum(amount).alias("_total"),
            F.when(F.count(amount) == F.count(F.lit(1)), F.min(amount)).alias("_least"),
        )
    )


def new_vs_returning_by_amount(invoices: DataFrame) -> DataFrame:
    """:func:`new_vs_returning` from one row of ``distinct_amounts`` per invoice, customer and instant."""
    earliest = F.min(F.struct("InvoiceDate", "InvoiceNo", "_least"))
    months = invoices.groupBy("CustomerID", cal.month_index(_date()).alias("_month")).agg(
        F.sum("_units").alias("_n"),
        F.sum("_total").alias("_sum"),
        earliest.alias("_earliest"),
    )
    return _new_and_returning(months.withColumn("_first_sum", F.col("_earliest._least")))


def new_vs_returning_by_order(invoices: DataFrame) -> DataFrame:
    """The same split with whole orders as the unit."""
    earliest = F.min(F.struct("InvoiceDate", "InvoiceNo", "Amount"))
    months = invoices.groupBy("CustomerID", cal.month_index(_date()).alias("_month")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("Amount").alias("_sum"),
        earliest.alias("_earliest"),
    )
    return _new_and_returning(months.withColumn("_first_sum", F.col("_earliest.Amount")))


def exec_summary(invoices: DataFrame, lines: DataFrame, customers: DataFrame) -> DataFrame:
    """One row of headline figures.

    ``lines`` only supplies the products; the other figures come from the invoice grain.
    """
    is_champion = F.col("segment") == "Champions"
    products = lines.agg(F.countDistinct("StockCode")).scalar()
    segments = customers.agg(
        F.struct(
            F.count_if(is_champion).alias("champions"),
            percent(
                F.sum(F.when(is_champion, F.col("monetary"))), F.sum("monetary"), 1
            ).alias("champion_share"),
            F.count_if(F.col("segment").isin("At Risk", "Cannot Lose Them")).alias("at_risk"),
        )
    ).scalar()
    return (
        invoices.agg(
            _revenue().alias("_revenue"),
            order_count(invoices).alias("_orders"),
            _buyers().alias("_buyers"),
            F.countDistinct("Country").alias("_countries"),
            F.min("InvoiceDate").alias("_from"),
            F.max("InvoiceDate").alias("_to"),
        )
        .withColumn("_segments", segments)
        .select(
            rounded(F.col("_revenue"), 0).alias("Total_Revenue_GBP"),
            F.col("_orders").alias("Total_Orders"),
            F.col("_buyers").alias("Total_Customers"),
            products.alias("Total_Products"),
            F.col("_countries").alias("Countries_Served"),
            rounded(_order_value(), 2).alias("Avg_Order_Value_GBP"),
            rounded(ratio(F.col("_revenue"), F.col("_buyers")), 2).alias(
                "Avg_Revenue_per_Customer_GBP"
            ),
            F.col("_from").alias("Data_From"),
            F.col("_to").alias("Data_To"),
            F.col("_segments.champions").alias("Champion_Customers"),
            F.col("_segments.champion_share").alias("Champions_Revenue_%"),
            F.col("_segments.at_risk").alias("At_Risk_Customers"),
        )
    )
