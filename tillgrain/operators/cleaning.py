"""From raw invoice lines to sales lines."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrain.config import CleaningConfig
from tillgrain.functions.calendar import month_label
from tillgrain.functions.ranking import digits_of, order_statistics, value_of
from tillgrain.functions.sketches import sketched_quantiles, sketches
from tillgrain.session import materialize
from tillgrain.sources.schemas import AMOUNT


def completed_sales(raw: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Lines with a customer, not cancelled, with positive quantity and price."""
    return (
        raw.dropna(subset=["CustomerID"])
        .filter(~F.col("InvoiceNo").cast("string").startswith(config.cancel_prefix))
        .filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))
        .withColumn("CustomerID", F.col("CustomerID").cast("bigint"))
        .withColumn("TotalAmount", (F.col("Quantity") * F.col("UnitPrice")).cast(AMOUNT))
        .withColumn("YearMonth", month_label(F.col("InvoiceDate")))
    )


def _scale(df: DataFrame, column: str) -> int:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        if kind.scale > 18:
            raise TypeError(f"exact quantiles keep at most 18 decimals, not {kind.scale}")
        return kind.scale
    if isinstance(kind, T.IntegralType):
        return 0
    raise TypeError(f"exact quantiles need an integer or decimal column, not {kind.simpleString()}")


def _unscaled(value: Column, scale: int) -> Column:
    """The decimal without its point; what does not fit a bigint is an error."""
    whole = F.floor(value)
    rest = ((value - whole).cast(f"decimal({scale + 1},{scale})") * F.lit(10**scale).cast("decimal(19,0)")).cast("bigint")
    room = F.abs(whole) < (2**63 - 1) // 10**scale - 1
    return F.when(
        value.isNull() | room, whole.cast("bigint") * F.lit(10**scale).cast("bigint") + rest
    ).otherwise(F.raise_error(F.lit("value too large for an exact quantile")))


def exact_quantiles(
    df: DataFrame, column: str, fractions: Sequence[float], copies: str | None = None
) -> DataFrame:
    """fraction, threshold, largest_kept: linearly interpolated quantiles, all in one search.

    ``largest_kept`` is the value just below or at the quantile. The lines are read once, to count
    each distinct value; the search runs on those counts. ``copies`` names a column that says for
    how many lines a row stands.
    """
    scale = _scale(df, column)
    unscaled = _unscaled(F.col(column), scale)
    names = ["_high", "_mid", "_low"]
    counted = F.sum(copies) if copies else F.count(F.lit(1))
    counts = materialize(
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(counted.alias("_copies"))
    ).select(
        F.lit(0).alias("_all"),
        "_copies",
        *[d.alias(n) for d, n in zip(digits_of(unscaled), names, strict=True)],
    )

    def position(total: Column, fraction: float) -> Column:
        return (total - 1).cast("double") * fraction

    def ranks(total: Column) -> Column:
        lower = [F.floor(position(total, f)) for f in fractions]
        return F.array(*[rank for r in lower for rank in (r, F.least(r + 1, total - 1))])

    found = order_statistics(counts, "_all", names, ranks, weight="_copies")
    value = value_of(*[F.col(n) for n in names])
    edges = found.groupBy(F.floor(F.col("slot") / 2).cast("int").alias("_at")).agg(
        F.max(F.when(F.col("slot") % 2 == 0, value)).alias("below"),
        F.max(F.when(F.col("slot") % 2 == 1, value)).alias("above"),
    )
    total = counts.agg(F.sum("_copies").alias("n")).scalar()
    step = F.col("position") - F.floor("position")
    unit = 10.0**scale
    below, above = F.col("below") / unit, F.col("above") / unit
    asked = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), position(total, f).alias("position")) for f in fractions])
    return (
        edges.withColumn("_asked", F.element_at(asked, F.col("_at") + 1))
        .select("below", "above", "_asked.*")
        .select(
            "fraction",
            (below + (above - below) * step).alias("threshold"),
            (F.col("below").cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale)))
            .cast(f"decimal(38,{scale})")
            .alias("largest_kept"),
        )
    )


def exact_quantile(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row: the quantile and the value just below or at it; nulls where there are no lines."""
    found = exact_quantiles(df, column, [fraction])
    return found.agg(F.max("threshold").alias("threshold"), F.max("largest_kept").alias("largest_kept"))


def drop_outliers(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """Keep rows up to the quantile of the rows themselves.

    No value lies between ``largest_kept`` and the interpolated threshold, so comparing with
    the former is the same test without floating point.
    """
    limit = exact_quantile(df, column, fraction).select("largest_kept").scalar()
    return df.filter(F.col(column) <= limit)


def drop_outliers_by_sketch(df: DataFrame, column: str, fraction: float, size: int) -> DataFrame:
    """Keep rows up to a sketched quantile: one pass, and a rank off by the sketch's error.

    The sketch has no interpolation; its quantile is a value of the column.
    """
    scale = _scale(df, column)
    unscaled = df.select(_unscaled(F.col(column), scale).alias("_value"))
    found = sketched_quantiles(sketches(unscaled, "_value", size=size), [fraction])
    return df.filter(_unscaled(F.col(column), scale) <= found.select("sketched").scalar())


def clean_sales(raw: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    sales = completed_sales(raw, config)
    if config.sketch_size is not None:
        return drop_outliers_by_sketch(sales, "Quantity", config.quantity_quantile, config.sketch_size)
    return drop_outliers(sales, "Quantity", config.quantity_quantile)
