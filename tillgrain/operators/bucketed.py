"""A star whose fact and customers are bucketed alike, for reports per customer without a shuffle.

Bucketing puts all lines of a customer in one task, which a customer with a large share of the
lines would make the whole run wait for. Such customers are stored apart: their lines lie in a
plain table, are reduced on the map side, and join as one row each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.functions import calendar as cal
from tillgrain.functions.numeric import ratio, rounded
from tillgrain.operators.star import as_published
from tillgrain.sources.writers import write_table

KEY = "customerid"
_TABLES = ("fact", "customers", "hot_fact", "hot_customers")


@dataclass(frozen=True)
class CustomerStar:
    """Bucketed ``fact`` and ``customers``; ``hot_fact`` and ``hot_customers`` of the few large ones."""

    fact: DataFrame
    customers: DataFrame
    hot_fact: DataFrame
    hot_customers: DataFrame

    @classmethod
    def write(cls, fact: DataFrame, customers: DataFrame, folder: str, buckets: int, name: str | None = None) -> CustomerStar:
        """Store the tables below ``folder`` under catalog names with one prefix.

        A customer is hot with more lines than an average bucket has; there are fewer of them
        than buckets. Lines without a customer take no part in reports per customer.
        """
        spark = fact.sparkSession
        name = name or f"star_{uuid.uuid4().hex}"
        fact = as_published(fact, "fact_transactions").filter(F.col(KEY).isNotNull())
        lines = fact.groupBy(KEY).agg(F.count(F.lit(1)).alias("_lines"))
        write_table(lines, f"{name}_lines", path=f"{folder}/lines")
        lines = spark.table(f"{name}_lines")
        fair = lines.agg(F.sum("_lines") / buckets).scalar()
        hot = lines.filter(F.col("_lines") > fair).select(KEY)
        people = as_published(customers, "dim_customers")
        for part, how in (("", "left_anti"), ("hot_", "left_semi")):
            bucketed = {"bucket_by": KEY, "buckets": buckets} if not part else {}
            # fewer rows than buckets
            write_table(fact.join(F.broadcast(hot), KEY, how), f"{name}_{part}fact", path=f"{folder}/{part}fact", **bucketed)
            write_table(people.join(F.broadcast(hot), KEY, how), f"{name}_{part}customers", path=f"{folder}/{part}customers", **bucketed)
        spark.sql(f"DROP TABLE {name}_lines")
        return cls.read(spark, name)

    @classmethod
    def read(cls, spark: SparkSession, name: str) -> CustomerStar:
        return cls(*[spark.table(f"{name}_{t}") for t in _TABLES])

    def per_customer(self, reduce) -> DataFrame:
        """``reduce(fact)`` joined to customers, whose frame has a row per ``customerid``."""
        regular = self.customers.hint("merge").join(reduce(self.fact), KEY)
        return regular.unionByName(self.hot_customers.join(reduce(self.hot_fact), KEY))


def segment_revenue(star: CustomerStar) -> DataFrame:
    """Customers, revenue and mean line value per segment; only segments are shuffled."""
    spent = star.per_customer(lambda fact: fact.groupBy(KEY).agg(F.sum("totalamount").alias("_spent"), F.count(F.lit(1)).alias("_rows")))
    sums = spent.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("_spent").alias("_revenue"), F.sum("_rows").alias("_lines")
    )
    return sums.select(
        "segment",
        "customers",
        rounded(F.col("_revenue"), 0).alias("total_revenue"),
        rounded(ratio(F.col("_revenue"), F.col("_lines")), 2).alias("avg_line_value"),
    )


def champions_deep_dive(star: CustomerStar, segment: str = "Champions") -> DataFrame:
    """Breadth and span of what champions buy, with no shuffle of the bucketed tables.

    Products and months are reduced apart, each from its own distinct rows, as both are known to
    lie with their customer.
    """

    def activity(fact: DataFrame) -> DataFrame:
        months = fact.groupBy(KEY, cal.month_index(F.col("invoicedate")).alias("_month")).agg(
            F.min("invoicedate").alias("_first"), F.max("invoicedate").alias("_last")
        )
        spans = months.groupBy(KEY).agg(
            F.count(F.lit(1)).alias("active_months"), F.min("_first").alias("first_purchase"), F.max("_last").alias("last_purchase")
        )
        products = fact.filter(F.col("stockcode").isNotNull()).groupBy(KEY, "stockcode").agg(F.count(F.lit(1)).alias("_n"))
        breadth = products.groupBy(KEY).agg(F.count(F.lit(1)).alias("unique_products_bought"))
        return spans.join(breadth.hint("merge"), KEY, "left").fillna(0, ["unique_products_bought"])

    chosen = CustomerStar(
        star.fact,
        star.customers.filter(F.col("segment") == segment),
        star.hot_fact,
        star.hot_customers.filter(F.col("segment") == segment),
    )
    return chosen.per_customer(activity).select(
        KEY,
        rounded(F.col("monetary"), 2).alias("lifetime_spend"),
        F.col("frequency").alias("total_orders"),
        rounded(F.col("avgordervalue"), 2).alias("avg_order_value"),
        F.col("recency").alias("days_since_purchase"),
        "unique_products_bought",
        "active_months",
        "first_purchase",
        "last_purchase",
    )
