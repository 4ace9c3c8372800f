"""Recency, frequency and monetary scores, segments and their summaries.

Input is the invoice grain (see :mod:`tillgrain.operators.grains`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.config import RfmConfig
from tillgrain.functions import calendar as cal
from tillgrain.functions.banding import first_match
from tillgrain.functions.numeric import money, percent, ratio, rounded
from tillgrain.functions.ranking import (
    bin_number,
    digits_of,
    middle_ranks,
    order_statistics,
    quantile_ranks,
    value_of,
)
from tillgrain.operators.grains import order_count
from tillgrain.session import materialize
from tillgrain.sources.schemas import MONEY_UNITS

# Segment rules as score ranges (recency, frequency, monetary), tried in order.
# Some later rules can never be reached because an earlier one covers them; they are kept so
# that the table shows it.
ANY = (1, 5)
SEGMENT_RULES = (
    ("Champions", (4, 5), (4, 5), ANY),
    ("Loyal Customers", (2, 5), (3, 5), ANY),
    ("Potential Loyalists", (3, 5), (1, 2), ANY),
    ("New Customers", (5, 5), (1, 1), ANY),
    ("Promising", (3, 5), (1, 1), ANY),
    ("At Risk", (1, 2), (3, 5), (3, 5)),
    ("Cannot Lose Them", (1, 1), (4, 5), (4, 5)),
    ("Hibernating", (1, 2), (1, 2), ANY),
)
LAST_SEGMENT = "Lost"

# Segment, description, marketing action, priority, colour.
SEGMENT_REFERENCE = (
    ("Champions", "Bought recently, buy often, spend the most", "Reward them. Early access. Ask for reviews.", 1, "#10b981"),
    ("Loyal Customers", "Buy regularly with solid frequency", "Upsell. Loyalty programme. Referral asks.", 2, "#3b82f6"),
    ("Potential Loyalists", "Recent buyers with low frequency — room to grow", "Membership offers. Personalised recommendations.", 3, "#6366f1"),
    ("At Risk", "Were good customers, now going cold", "Win-back email. Renewal discount.", 4, "#f59e0b"),
    ("Hibernating", "Low recency and low frequency — gone quiet", "Reactivation campaign. Low-cost channel.", 5, "#94a3b8"),
    ("Lost", "Have not bought in a very long time", "Ignore or very cheap re-engagement only.", 6, "#475569"),
    ("New Customers", "Very recent, only 1-2 orders so far", "Onboarding flow. First-purchase follow-up.", 7, "#8b5cf6"),
    ("Promising", "Recent-ish buyers with some frequency", "Brand awareness. Free trials or samples.", 8, "#a78bfa"),
    ("Cannot Lose Them", "High historical value but have disappeared", "Personal outreach. Special offer. ASAP.", 9, "#ef4444"),
)

# Segments that call for attention.
INSIGHT_SEGMENTS = ("Champions", "At Risk", "Cannot Lose Them")


def segment_reference(spark: SparkSession) -> DataFrame:
    """The nine segments with description, action, priority and colour."""
    return spark.createDataFrame(
        list(SEGMENT_REFERENCE),
        "segment string, description string, marketingaction string, priority int, colorhex string",
    )


def rfm_base(
    invoices: DataFrame, config: RfmConfig = RfmConfig(), figures: Sequence[Column] = ()
) -> DataFrame:
    """Recency, Frequency, Monetary and line count of each customer, as a written table.

    The scores below read it several times; the lines are scanned only here. ``figures`` are
    further aggregates of a customer's invoices.
    """
    grouped = materialize(
        invoices.groupBy("CustomerID").agg(
            F.max("InvoiceDate").alias("LastPurchaseDate"),
            order_count(invoices).alias("Frequency"),
            F.sum("Amount").alias("Monetary"),
            F.sum("Lines").alias("Lines"),
            *figures,
        )
    )
    latest = grouped.agg(F.max("LastPurchaseDate")).scalar()
    recency = cal.whole_days(
        F.col("LastPurchaseDate"), cal.plus_days(latest, config.snapshot_offset_days)
    )
    return grouped.filter(F.col("CustomerID").isNotNull()).withColumn(
        "Recency", recency.cast("bigint")
    )


def _spend_units() -> Column:
    return (F.col("Monetary") * MONEY_UNITS).cast("bigint")


def _sort_keys(rfm: DataFrame) -> DataFrame:
    """One row per customer and metric with the digits of its sort key.

    Frequency is ranked "first come": ties in order of CustomerID, so its key is the pair.
    """
    spend = _spend_units()
    none = F.lit(0).cast("bigint")

    def key(metric: str, lead: Column, value: Column) -> Column:
        high, mid, low = digits_of(value)
        return F.struct(
            F.lit(metric).alias("metric"),
            lead.alias("d0"),
            high.alias("d1"),
            mid.alias("d2"),
            low.alias("d3"),
        )

    return rfm.select(
        F.inline(
            F.array(
                key("R", none, F.col("Recency")),
                key("F", F.col("Frequency"), F.col("CustomerID")),
                key("M", none, spend),
            )
        )
    )


def score_edges(rfm: DataFrame, bins: int) -> DataFrame:
    """One row with a struct: for R, F and M the ordered ``(lead, value)`` keys between the bins."""
    digits = ["d0", "d1", "d2", "d3"]
    found = order_statistics(_sort_keys(rfm), "metric", digits, quantile_ranks(bins))
    edge = F.struct(
        F.col("d0").alias("lead"), value_of(F.col("d1"), F.col("d2"), F.col("d3")).alias("value")
    )

    def of(metric: str) -> Column:
        kept = F.collect_list(F.when(F.col("metric") == metric, edge))
        return F.array_sort(kept).alias(metric)

    return found.agg(F.struct(of("R"), of("F"), of("M")).alias("edges"))


def score_rfm(rfm: DataFrame, config: RfmConfig = RfmConfig()) -> DataFrame:
    """Quintile scores (recency inverted), the three-digit code and the total.

    The edges are a handful of values that Spark computes once and plugs in as constants, so
    scoring itself is a projection without a shuffle.
    """
    none = F.lit(0).cast("bigint")

    def bin_of(metric: str, lead: Column, value: Column) -> Column:
        key = F.struct(lead.alias("lead"), value.cast("bigint").alias("value"))
        return bin_number(key, F.col("_edges")[metric])

    return (
        rfm.withColumn("_edges", score_edges(rfm, config.bins).scalar())
        .withColumns(
            {
                "R_Score": F.lit(config.bins + 1) - bin_of("R", none, F.col("Recency")),
                "F_Score": bin_of("F", F.col("Frequency"), F.col("CustomerID")),
                "M_Score": bin_of("M", none, _spend_units()),
            }
        )
        .drop("_edges")
        .withColumn(
            "RFM_Score", F.concat(*[F.col(f"{m}_Score").cast("string") for m in ("R", "F", "M")])
        )
        .withColumn("RFM_Total", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))
    )


def assign_segment(r: Column, f: Column, m: Column) -> Column:
    def holds(score: Column, bounds: tuple[int, int]) -> Column:
        return score.between(*bounds)

    return first_match(
        [
            (holds(r, rs) & holds(f, fs) & holds(m, ms), name)
            for name, rs, fs, ms in SEGMENT_RULES
        ],
        LAST_SEGMENT,
    )


def apply_segments(scored: DataFrame) -> DataFrame:
    """Segment and recommended action of each customer."""
    segment = assign_segment(F.col("R_Score"), F.col("F_Score"), F.col("M_Score"))
    actions = first_match(
        [(F.col("Segment") == row[0], row[2]) for row in SEGMENT_REFERENCE], None
    )
    return scored.withColumn("Segment", segment).withColumn("Action", actions)


def rfm_segments(invoices: DataFrame, config: RfmConfig = RfmConfig()) -> DataFrame:
    """Invoices to scored and segmented customers, as a written table.

    Reports filter and group it many times; from a table their predicates reach the scan.
    """
    scored = rfm_base(invoices, config).transform(score_rfm, config)
    return materialize(scored.transform(apply_segments))


def segment_distribution(customers: DataFrame) -> DataFrame:
    """Customers per segment with their share; windows run on at most nine rows."""
    everyone = Window.partitionBy()
    return (
        customers.groupBy("Segment")
        .agg(F.count(F.lit(1)).alias("Customers"))
        .withColumn("Share_%", percent(F.col("Customers"), F.sum("Customers").over(everyone), 1))
        .orderBy(F.desc("Customers"), "Segment")
    )


def median_monetary(customers: DataFrame) -> DataFrame:
    """Exact median spend per segment, without gathering a segment in one task."""
    names = ["d1", "d2", "d3"]
    keys = customers.select(
        "Segment", *[d.alias(n) for d, n in zip(digits_of(_spend_units()), names, strict=True)]
    )
    found = order_statistics(keys, "Segment", names, middle_ranks)
    both = F.sum(value_of(*[F.col(n) for n in names])).cast("decimal(30,0)")
    return found.groupBy("Segment").agg((both / (2 * MONEY_UNITS)).alias("Median_Revenue"))


def segment_summary(customers: DataFrame) -> DataFrame:
    """Key figures per segment, largest revenue first. ``customers`` is read several times."""
    everyone = Window.partitionBy()
    count = F.col("Customers")
    return (
        customers.groupBy("Segment")
        .agg(
            F.count(F.lit(1)).alias("Customers"),
            F.sum("Monetary").alias("_revenue"),
            F.sum("Recency").alias("_recency"),
            F.sum("Frequency").alias("_frequency"),
            F.sum("RFM_Total").alias("_score"),
        )
        .join(median_monetary(customers), "Segment")
        .select(
            "Segment",
            "Customers",
            money(F.col("_revenue")).alias("Total_Revenue"),
            rounded(ratio(F.col("_revenue"), count), 2).alias("Avg_Revenue"),
            rounded(F.col("Median_Revenue"), 2).alias("Median_Revenue"),
            rounded(ratio(F.col("_recency"), count), 1).alias("Avg_Recency_Days"),
            rounded(ratio(F.col("_frequency"), count), 1).alias("Avg_Frequency"),
            rounded(ratio(F.col("_score"), count), 1).alias("Avg_RFM_Score"),
            percent(count, F.sum(count).over(everyone), 1).alias("Customer_Share_%"),
            percent(F.col("_revenue"), F.sum("_revenue").over(everyone), 1).alias("Revenue_Share_%"),
        )
        .orderBy(F.desc("Total_Revenue"), "Segment")
    )


def rfm_insights(summary: DataFrame) -> DataFrame:
    """The summary rows that call for attention, with the action to take."""
    action = first_match([(F.col("Segment") == r[0], r[2]) for r in SEGMENT_REFERENCE], None)
    return summary.filter(F.col("Segment").isin(*INSIGHT_SEGMENTS)).select(
        "Segment",
        "Customers",
        "Customer_Share_%",
        "Total_Revenue",
        "Revenue_Share_%",
        action.alias("Action"),
    )
