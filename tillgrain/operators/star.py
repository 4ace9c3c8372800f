"""Star schema: four dimensions built from sales lines, a segment reference and one fact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrain.config import RfmConfig
from tillgrain.functions import calendar as cal
from tillgrain.functions.numeric import ratio, ratio_or_zero, rounded
from tillgrain.operators.grains import invoice_grain, order_count, totals_and_distincts
from tillgrain.operators.rfm import rfm_segments, segment_reference
from tillgrain.session import materialize
from tillgrain.sources.schemas import STAR_TYPES
from tillgrain.sources.versions import Refresh, Store
from tillgrain.sources.writers import write_parquet

FACT_PARTITIONS = ("year", "month")


def dim_customers(segmented: DataFrame) -> DataFrame:
    """One row per customer; ``lines`` (count of fact rows) rides along for the reports."""
    average = rounded(ratio_or_zero(F.col("Monetary"), F.col("Frequency")), 2)
    return segmented.select(
        F.col("CustomerID").alias("customerid"),
        F.col("Recency").alias("recency"),
        F.col("Frequency").alias("frequency"),
        F.col("Monetary").alias("monetary"),
        F.col("R_Score").alias("r_score"),
        F.col("F_Score").alias("f_score"),
        F.col("M_Score").alias("m_score"),
        F.col("RFM_Total").alias("rfm_total"),
        F.col("RFM_Score").alias("rfm_score"),
        F.col("Segment").alias("segment"),
        F.to_date("LastPurchaseDate").alias("lastpurchasedate"),
        average.alias("avgordervalue"),
        F.col("Lines").alias("lines"),
    )


def first_descriptions(lines: DataFrame) -> DataFrame:
    """The earliest description of each product; by text on the same instant.

    Lines are reduced to one row per product and text before texts are compared, and that
    step keeps only a time stamp per group, so it hashes instead of sorting the lines.
    """
    texts = (
        lines.filter(F.col("Description").isNotNull())
        .groupBy("StockCode", "Description")
        .agg(F.min("InvoiceDate").alias("_since"))
    )
    return texts.groupBy("StockCode").agg(
        F.min(F.struct("_since", "Description"))["Description"].alias("description")
    )


def dim_products(lines: DataFrame) -> DataFrame:
    """Sales and reach per product, from lines that are written once."""
    lines = materialize(lines)
    stats = totals_and_distincts(
        lines,
        "StockCode",
        [
            rounded(ratio(F.sum("UnitPrice"), F.count("UnitPrice")), 2).alias("avgunitprice"),
            F.sum(F.col("Quantity").cast("bigint")).alias("totalquantitysold"),
            F.sum("TotalAmount").alias("totalrevenue"),
        ],
        [
            F.countDistinct("CustomerID").alias("uniquecustomers"),
            F.countDistinct("InvoiceNo").alias("uniqueinvoices"),
        ],
    )
    products = materialize(stats.join(first_descriptions(lines), "StockCode", "left"))
    widest = products.agg(F.max("uniquecustomers")).scalar()
    return products.select(
        F.col("StockCode").alias("stockcode"),
        "description",
        "avgunitprice",
        "totalquantitysold",
        "totalrevenue",
        "uniquecustomers",
        "uniqueinvoices",
        rounded(ratio_or_zero(F.col("uniquecustomers"), widest), 4).alias("popularityscore"),
    )


def dim_date(lines: DataFrame) -> DataFrame:
    """One row per day with sales."""
    day = F.col("datekey")
    return lines.select(F.to_date("InvoiceDate").alias("datekey")).distinct().select(
        "datekey",
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        cal.month_name(day).alias("monthname"),
        F.quarter(day).alias("quarter"),
        F.concat(F.lit("Q"), F.quarter(day).cast("string")).alias("quartername"),
        F.dayofmonth(day).alias("day"),
        cal.weekday(day).alias("dayofweek"),
        cal.day_name(day).alias("dayname"),
        cal.weekend_flag(day).alias("isweekend"),
        cal.month_label(day).alias("yearmonth"),
        cal.quarter_label(day).alias("yearquarter"),
    )


def dim_geography(invoices: DataFrame, home_market: str = "United Kingdom") -> DataFrame:
    """Sales per country, ranked; the window runs on one row per country."""
    stats = (
        invoices.filter(F.col("Country").isNotNull())
        .groupBy(F.col("Country").alias("country"))
        .agg(
            F.sum("Amount").alias("_revenue"),
            order_count(invoices).alias("totalorders"),
            F.countDistinct("CustomerID").alias("uniquecustomers"),
        )
    )
    ranking = Window.partitionBy().orderBy(F.desc("totalrevenue"))
    return stats.select(
        "country",
        (F.col("country") == home_market).cast("int").alias("isuk"),
        F.col("_revenue").alias("totalrevenue"),
        "totalorders",
        "uniquecustomers",
        rounded(ratio_or_zero(F.col("_revenue"), F.col("totalorders")), 2).alias("avgordervalue"),
    ).withColumn("revenuerank", F.dense_rank().over(ranking))


def fact_transactions(lines: DataFrame) -> DataFrame:
    """Lines with the date parts that reports filter and the table is partitioned by."""
    when = F.col("InvoiceDate")
    return lines.select(
        F.col("CustomerID").alias("customerid"),
        F.col("StockCode").alias("stockcode"),
        F.to_date(when).alias("datekey"),
        F.col("Country").alias("country"),
        F.col("InvoiceNo").alias("invoiceno"),
        when.alias("invoicedate"),
        F.col("Quantity").alias("quantity"),
        F.col("UnitPrice").alias("unitprice"),
        F.col("TotalAmount").alias("totalamount"),
        F.year(when).alias("year"),
        F.month(when).alias("month"),
        F.quarter(when).alias("quarter"),
        cal.weekday(when).alias("dayofweek"),
        cal.weekend_flag(when).alias("isweekend"),
        cal.month_label(when).alias("yearmonth"),
    )


def touched_months(fact: DataFrame) -> list[tuple[int, int]]:
    """Months that fact rows lie in; as many as the calendar has."""
    return sorted((r.year, r.month) for r in fact.select(*FACT_PARTITIONS).distinct().collect())


def within_months(when: Column, months: Sequence[tuple[int, int]]) -> Column:
    """Whether a time lies in one of the months, as ranges that a scan can skip files by."""
    numbers = sorted({12 * y + m - 1 for y, m in months})
    inside = F.lit(False)
    for i, first in enumerate(numbers):
        if i and numbers[i - 1] == first - 1:
            continue  # within the range before
        last = first
        while last + 1 in numbers:
            last += 1
        begin, end = (f"{n // 12:04d}-{n % 12 + 1:02d}-01" for n in (first, last + 1))
        inside = inside | ((when >= F.lit(begin).cast("timestamp_ntz")) & (when < F.lit(end).cast("timestamp_ntz")))
    return inside


def lines_of_fact(fact: DataFrame) -> DataFrame:
    """Fact rows under the names of sales lines, so that every analysis runs on a stored fact."""
    return fact.select(
        F.col("customerid").alias("CustomerID"),
        F.col("stockcode").alias("StockCode"),
        F.col("country").alias("Country"),
        F.col("invoiceno").alias("InvoiceNo"),
        F.col("invoicedate").alias("InvoiceDate"),
        F.col("quantity").alias("Quantity"),
        F.col("unitprice").alias("UnitPrice"),
        F.col("totalamount").alias("TotalAmount"),
    )


@dataclass(frozen=True)
class Star:
    """The six tables."""

    dim_customers: DataFrame
    dim_products: DataFrame
    dim_date: DataFrame
    dim_geography: DataFrame
    dim_rfm_segments: DataFrame
    fact_transactions: DataFrame

    @classmethod
    def build(
        cls,
        lines: DataFrame,
        home_market: str = "United Kingdom",
        rfm: RfmConfig = RfmConfig(),
    ) -> Star:
        invoices = materialize(invoice_grain(lines))
        return cls(
            dim_customers=dim_customers(rfm_segments(invoices, rfm)),
            dim_products=dim_products(lines),
            dim_date=dim_date(invoices),
            dim_geography=dim_geography(invoices, home_market),
            dim_rfm_segments=segment_reference(lines.sparkSession),
            fact_transactions=fact_transactions(lines),
        )

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Star:
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(cls)})

    @classmethod
    def at(cls, store: Store, version: int | None = None) -> Star:
        """The tables of one version of a store, all of the same refresh."""
        if version is None:
            version = store.manifest().version
        return cls(**{f.name: store.table(f.name, version) for f in fields(cls)})

    def refresh(self, store: Store, months: Sequence[tuple[int, int]] | None = None) -> int:
        """Publish a new version: all dimensions, and of the fact only the (year, month) touched.

        Without ``months`` the whole fact is new. Readers see the version before until all tables
        are written. Returns the version.
        """
        change = store.refresh()
        for f in fields(self):
            frame = getattr(self, f.name)
            if f.name == "fact_transactions":
                replace_months(change, frame, months)
            else:
                change.replace(f.name, as_published(frame, f.name) if f.name in STAR_TYPES else frame)
        return change.publish()

    def write(self, folder: str) -> None:
        """Full refresh, dimensions first; the fact is partitioned by year and month.

        Tables are stored with the published columns and types; the segment reference has none
        beyond its own.
        """
        for f in fields(self):
            frame = getattr(self, f.name)
            if f.name in STAR_TYPES:
                frame = as_published(frame, f.name)
            partitions = FACT_PARTITIONS if f.name == "fact_transactions" else ()
            write_parquet(frame, f"{folder}/{f.name}", partitions)


def replace_months(change: Refresh, fact: DataFrame, months: Sequence[tuple[int, int]] | None = None) -> None:
    """Put the touched months of a fact into a change of its store (None: the whole fact)."""
    name = "fact_transactions"
    touched = touched_months(fact) if months is None else sorted(set(months))
    if months is None and name in change.next.tables:
        change.next.tables[name]["parts"] = {}
    inside = fact.filter(within_months(F.col("invoicedate"), touched))
    change.replace_partitions(name, as_published(inside, name), FACT_PARTITIONS, touched)


def as_published(frame: DataFrame, name: str) -> DataFrame:
    """Columns and types of the published schema; a value its type cannot hold is an error."""

    def held(column: str, kind: str) -> Column:
        value = F.col(column)
        narrow = value.try_cast(kind)
        refused = F.raise_error(F.concat(F.lit(f"{name}.{column} exceeds {kind}: "), value.cast("string")))
        return F.when(value.isNull() | narrow.isNotNull(), narrow).otherwise(refused).cast(kind).alias(column)

    return frame.select(*[held(column, kind) for column, kind in STAR_TYPES[name].items()])
