"""Coarser grains that most analyses can start from instead of raw lines.

They are plain aggregations, so they combine on the map side and a hot invoice or customer
is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.functions.calendar import month_index


UNIQUE = "one_row_per_value"


def unique(column: Column, name: str) -> Column:
    """Mark a column of a grain that has one row per value of it."""
    return column.alias(name, metadata={UNIQUE: True})


def order_count(invoices: DataFrame) -> Column:
    """Orders within a group of the invoice grain: rows, where each invoice is known to be one row.

    Lines from files may give an invoice several rows (two time stamps, two countries); then the
    numbers are counted apart.
    """
    if invoices.schema["InvoiceNo"].metadata.get(UNIQUE):
        return F.count(F.lit(1))
    return F.countDistinct("InvoiceNo")


def invoice_grain(lines: DataFrame) -> DataFrame:
    """Lines, pieces and amount per invoice, customer, time stamp and country."""
    keys = [c for c in ("InvoiceNo", "CustomerID", "InvoiceDate", "Country") if c in lines.columns]
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Lines"),
        F.sum(F.col("Quantity").cast("bigint")).alias("Quantity"),
        F.sum("TotalAmount").alias("Amount"),
    )


def totals_and_distincts(
    rows: DataFrame, key: str, totals: Sequence[Column], distincts: Sequence[Column]
) -> DataFrame:
    """Sums and distinct counts per non-null key, from two narrow passes joined by key.

    In a single aggregation every row of the distinct counts would carry the empty buffers of
    all sums through the shuffle. Apart, the sums shrink to one row per key on the map side
    and only the bare values are shuffled for counting.
    """
    rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*totals).join(rows.groupBy(key).agg(*distincts), key)


def customer_months(invoices: DataFrame) -> DataFrame:
    """Amount per customer and active month; a customer has few rows here by the calendar."""
    return (
        invoices.filter(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID", month_index(F.col("InvoiceDate")).alias("Month"))
        .agg(F.sum("Amount").alias("Amount"))
    )
