"""Monthly acquisition cohorts: retention and revenue by months since first purchase.

Matrices are kept in long form, one row per cohort and index; wide views list their columns.
After :func:`customer_months` a customer has at most one row per calendar month, which bounds
every window here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.config import COHORT_QUALITY, Ladder
from tillgrain.functions import calendar as cal
from tillgrain.functions.banding import at_least
from tillgrain.functions.numeric import money, ratio, rounded
from tillgrain.operators.grains import customer_months
from tillgrain.session import materialize

SUMMARY_MONTHS = (1, 3, 6)
CHART_MONTHS = 12


def assign_cohorts(lines: DataFrame) -> DataFrame:
    """Every line with its month, its customer's first month and the months in between.

    First months are aggregated, written and joined back instead of taken in a window over the
    lines, so that the lines of one customer need not meet in one task.
    """
    lines = lines.withColumn("_month", cal.month_index(F.col("InvoiceDate")))
    first = materialize(
        lines.filter(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.min("_month").alias("_cohort"))
    )
    return (
        lines.join(first, "CustomerID", "left")
        .withColumns(
            {
                "TransactionMonth": cal.label_of_index(F.col("_month")),
                "CohortMonth": cal.label_of_index(F.col("_cohort")),
                "CohortIndex": F.col("_month") - F.col("_cohort"),
            }
        )
        .drop("_month", "_cohort")
    )


def cohort_cells(invoices: DataFrame) -> DataFrame:
    """Customers and revenue per cohort and index."""
    by_customer = Window.partitionBy("CustomerID")
    return (
        customer_months(invoices)
        .withColumn("_cohort", F.min("Month").over(by_customer))
        .groupBy("_cohort", (F.col("Month") - F.col("_cohort")).alias("CohortIndex"))
        .agg(F.count(F.lit(1)).alias("Customers"), F.sum("Amount").alias("Revenue"))
        .select(
            cal.label_of_index(F.col("_cohort")).alias("CohortMonth"),
            "CohortIndex",
            "Customers",
            "Revenue",
        )
    )


def cohort_extent(cells: DataFrame) -> DataFrame:
    """Number of cohorts and the longest history."""
    return cells.agg(
        F.countDistinct("CohortMonth").alias("Cohorts"), F.max("CohortIndex").alias("MaxIndex")
    )


def cohort_counts(cells: DataFrame) -> DataFrame:
    return cells.select("CohortMonth", "CohortIndex", "Customers")


def retention_long(cells: DataFrame) -> DataFrame:
    """Percentage of the cohort's first-month customers seen at each index."""
    of_cohort = Window.partitionBy("CohortMonth")
    size = F.max(F.when(F.col("CohortIndex") == 0, F.col("Customers"))).over(of_cohort)
    return cells.select(
        "CohortMonth",
        "CohortIndex",
        "Customers",
        (ratio(F.col("Customers"), size) * 100).alias("Retention"),
    )


def revenue_long(cells: DataFrame) -> DataFrame:
    """Revenue per active customer of each cell."""
    return cells.select(
        "CohortMonth",
        "CohortIndex",
        money(F.col("Revenue")).alias("TotalRevenue"),
        F.col("Customers").alias("UniqueCustomers"),
        rounded(ratio(F.col("Revenue"), F.col("Customers")), 2).alias("AvgRevenue"),
    )


def wide(long: DataFrame, value: str, last_index: int) -> DataFrame:
    """One row per cohort with columns M0 … M<last_index>; cells without data are null.

    Naming the columns saves the pass that would look for them. A cell past the last column is
    an error, so that no view drops data unseen.
    """
    index = F.col("CohortIndex")
    column = F.when(index <= last_index, F.concat(F.lit("M"), index.cast("string"))).otherwise(
        F.raise_error(F.concat(F.lit(f"a cell lies past M{last_index}: M"), index.cast("string")))
    )
    return (
        long.withColumn("_column", column)
        .groupBy("CohortMonth")
        .pivot("_column", [f"M{i}" for i in range(last_index + 1)])
        .agg(F.max(value))
        .orderBy("CohortMonth")
    )


def last_index(cells: DataFrame) -> int:
    """Longest history, as one number, for a full wide view."""
    return cells.agg(F.max("CohortIndex")).first()[0] or 0


def retention_matrix(cells: DataFrame, months: int | None = None) -> DataFrame:
    last = last_index(cells) if months is None else months
    return wide(retention_long(cells), "Retention", last)


def revenue_matrix(cells: DataFrame, months: int | None = None) -> DataFrame:
    last = last_index(cells) if months is None else months
    return wide(revenue_long(cells), "AvgRevenue", last)


def cohort_summary(retention: DataFrame, quality: Ladder = COHORT_QUALITY) -> DataFrame:
    """Size, retention after one, three and six months, and a label from the unrounded first."""

    def at(index: int, column: str = "Retention"):
        return F.max(F.when(F.col("CohortIndex") == index, F.col(column)))

    raw = retention.groupBy("CohortMonth").agg(
        at(0, "Customers").alias("CohortSize"),
        *[at(m).alias(f"_m{m}") for m in SUMMARY_MONTHS],
    )
    label = F.when(F.col("_m1").isNull(), F.lit("Insufficient data")).otherwise(
        at_least(F.col("_m1"), quality)
    )
    return raw.select(
        "CohortMonth",
        "CohortSize",
        *[rounded(F.col(f"_m{m}"), 1).alias(f"M{m}_Retention_%") for m in SUMMARY_MONTHS],
        label.alias("CohortQuality"),
    ).orderBy("CohortMonth")


def best_and_worst(summary: DataFrame) -> DataFrame:
    """One row: cohorts with the highest and lowest first-month retention, and label counts."""
    m1 = F.col("M1_Retention_%")
    row = F.struct(F.col("CohortMonth"), m1.alias("M1"), F.col("CohortSize"))
    known = F.when(m1.isNotNull(), row)
    # earliest cohort on ties: the order key carries the month index negated for the maximum
    month = F.regexp_replace("CohortMonth", "-", "").cast("int")
    best = F.max_by(known, F.when(m1.isNotNull(), F.struct(m1, -month)))
    worst = F.min_by(known, F.when(m1.isNotNull(), F.struct(m1, month)))
    quality = F.col("CohortQuality")
    return (
        summary.agg(
            best.alias("b"),
            worst.alias("w"),
            F.avg(m1).alias("m"),
            F.count_if(quality == "Strong").alias("Strong_Cohorts"),
            F.count_if(quality == "Weak").alias("Weak_Cohorts"),
        )
        .select(
            F.col("b.CohortMonth").alias("Best_Cohort"),
            F.col("b.M1").alias("Best_M1_%"),
            F.col("b.CohortSize").alias("Best_Size"),
            F.col("w.CohortMonth").alias("Worst_Cohort"),
            F.col("w.M1").alias("Worst_M1_%"),
            F.col("w.CohortSize").alias("Worst_Size"),
            rounded(F.col("m"), 1).alias("Avg_M1_%"),
            "Strong_Cohorts",
            "Weak_Cohorts",
        )
    )


def average_curve(retention: DataFrame, months: int = CHART_MONTHS) -> DataFrame:
    """Mean retention per index over the cohorts that have it."""
    return (
        retention.filter(F.col("CohortIndex") <= months)
        .groupBy("CohortIndex")
        .agg(F.count(F.lit(1)).alias("Cohorts"), F.avg("Retention").alias("_mean"))
        .select("CohortIndex", "Cohorts", rounded(F.col("_mean"), 4).alias("Avg_Retention_%"))
        .orderBy("CohortIndex")
    )
