"""Invoice lines as a view over normalized order tables.

``lineitem`` carries the lines, ``orders`` the invoice header, ``customer``/``nation`` the
country and ``part`` the product. Every builder joins only the tables its columns need. The
lookups are outer joins on unique keys and every line has its order, so leaving a table out
never changes the row count.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.operators.grains import unique
from tillgrain.session import tune

ALL_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
    "TotalAmount",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents() -> Column:
    """The line amount in whole cents. The source stores two-digit amounts as doubles."""
    return F.rint(F.col("l_extendedprice") * 100).cast("bigint")


def _as_money(cents: Column, digits: int) -> Column:
    """Cents of up to ``digits`` digits as a decimal that still fits a machine word."""
    return (cents.cast(f"decimal({digits},0)") * F.lit(Decimal("0.01"))).cast(
        f"decimal({digits},2)"
    )


def _unit_price():
    """Price per piece in whole cents, halves up, by integer arithmetic."""
    pieces = F.col("l_quantity").cast("bigint")
    return _as_money(F.call_function("div", _cents() * 2 + pieces, pieces * 2), 12)


def countries(spark: SparkSession, folder: str) -> DataFrame:
    """Customer to country."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("CustomerID"), F.col("n_name").alias("Country")
    )


def headers(spark: SparkSession, folder: str, country: bool = False) -> DataFrame:
    """Invoice headers, with the customer's country where asked for."""
    found = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("InvoiceNo"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderdate").alias("InvoiceDate"),
    )
    return found.join(countries(spark, folder), "CustomerID", "left") if country else found


def sales_lines(
    spark: SparkSession,
    folder: str,
    columns: tuple[str, ...] = ALL_COLUMNS,
    item: str = "p_name",
) -> DataFrame:
    """One row per line with the asked columns; ``item`` is the product text column."""
    tune(spark)
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("InvoiceNo"),
        F.col("l_partkey").alias("StockCode"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        _unit_price().alias("UnitPrice"),
        _as_money(_cents(), 12).alias("TotalAmount"),
    )
    wanted = set(columns)
    if wanted & {"CustomerID", "InvoiceDate", "Country"}:
        lines = lines.join(headers(spark, folder, country="Country" in wanted), "InvoiceNo")
    if "Description" in wanted:
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("StockCode"), F.col(item).alias("Description")
        )
        lines = lines.join(parts, "StockCode", "left")
    return lines.select(*columns)


def invoices(spark: SparkSession, folder: str, country: bool = False) -> DataFrame:
    """The invoice grain: lines are summed per order before the header is joined.

    The sum combines on the map side, so an order with very many lines costs nothing extra,
    and the join that follows is one row to one row.
    """
    tune(spark)
    totals = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("InvoiceNo"))
        .agg(
            F.count(F.lit(1)).alias("Lines"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("Quantity"),
            F.sum(_cents()).alias("_cents"),
        )
        .withColumn("Amount", _as_money(F.col("_cents"), 15))
        .drop("_cents")
    )
    joined = totals.join(headers(spark, folder, country), "InvoiceNo")
    return joined.withColumn("InvoiceNo", unique(F.col("InvoiceNo"), "InvoiceNo"))


def raw_lines(
    spark: SparkSession,
    folder: str,
    cancel_status: str = "P",
    return_flag: str | None = None,
    texts: bool = True,
) -> DataFrame:
    """Uncleaned lines with all input columns; without ``texts`` no Description and Country.

    Orders of ``cancel_status`` carry the cancel prefix in their number; lines of
    ``return_flag`` are returns, with a negative quantity.
    """
    tune(spark)
    marked = F.when(F.col("o_orderstatus") == cancel_status, F.lit("C")).otherwise(F.lit(""))
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(marked, F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderdate").alias("InvoiceDate"),
    )
    pieces = F.col("l_quantity").cast("int")
    returned = F.coalesce(F.col("l_returnflag") == return_flag, F.lit(False)) if return_flag else F.lit(False)
    lines = (
        table(spark, folder, "lineitem")
        .select(
            "l_orderkey",
            F.col("l_partkey").alias("StockCode"),
            F.when(returned, -pieces).otherwise(pieces).alias("Quantity"),
            _unit_price().alias("UnitPrice"),
        )
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .drop("l_orderkey", "o_orderkey")
    )
    return with_texts(spark, folder, lines) if texts else lines


def with_texts(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """Lines with the product's text and the customer's country; best after they are filtered."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("StockCode"), F.col("p_name").alias("Description")
    )
    return lines.join(countries(spark, folder), "CustomerID", "left").join(parts, "StockCode", "left")
