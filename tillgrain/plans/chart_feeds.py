"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.functions.numeric import ratio, rounded
from tillgrain.operators.cohort import CHART_MONTHS


def rfm_scatter(customers: DataFrame) -> DataFrame:
    """Recency, frequency and a bubble size from 10 to 210 by spend.

    The extremes are one row that Spark computes first and plugs in as constants.
    """
    spend = customers.agg(
        F.struct(F.min("monetary").alias("least"), F.max("monetary").alias("most")).alias("range")
    ).scalar()
    least, most = F.col("_range.least"), F.col("_range.most")
    size = F.coalesce(ratio(F.col("monetary") - least, most - least), F.lit(0.0)) * 200 + 10
    return customers.withColumn("_range", spend).select(
        "customerid", "segment", "recency", "frequency", rounded(size, 4).alias("size")
    )


def rfm_heatmap(customers: DataFrame, bins: int = 5) -> DataFrame:
    """Mean spend by recency score (rows, best first) and frequency score (columns)."""
    scores = list(range(1, bins + 1))
    cells = (
        customers.groupBy("r_score", "f_score")
        .agg(rounded(ratio(F.sum("monetary"), F.count(F.lit(1))), 2).alias("_mean"))
        .groupBy(F.col("r_score").alias("R_Score"))
        .pivot("f_score", scores)
        .agg(F.max("_mean"))
    )
    return cells.select("R_Score", *[F.col(str(s)).alias(f"F{s}") for s in scores]).orderBy(
        F.desc("R_Score")
    )


def retention_heatmap(retention: DataFrame, revenue: DataFrame, months: int = CHART_MONTHS) -> DataFrame:
    """Retention and revenue cells of the first months in long form."""
    return (
        retention.select("CohortMonth", "CohortIndex", rounded(F.col("Retention"), 4).alias("Retention_%"))
        .join(revenue.select("CohortMonth", "CohortIndex", "AvgRevenue"), ["CohortMonth", "CohortIndex"])
        .filter(F.col("CohortIndex") <= months)
        .orderBy("CohortMonth", "CohortIndex")
    )


def retention_curves(retention: DataFrame, months: int = CHART_MONTHS) -> DataFrame:
    """Points of the cohorts with at least two of them in the charted months."""
    points = F.count(F.lit(1)).over(Window.partitionBy("CohortMonth"))
    return (
        retention.filter(F.col("CohortIndex") <= months)
        .withColumn("_points", points)
        .filter(F.col("_points") >= 2)
        .select("CohortMonth", "CohortIndex", rounded(F.col("Retention"), 4).alias("Retention_%"))
        .orderBy("CohortMonth", "CohortIndex")
    )
