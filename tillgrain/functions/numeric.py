"""Ratios and rounding with the meaning of SQL NUMERIC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, on the decimal reading of ``value``.

    The four spare digits keep a double such as 1.005 on the side its decimal reading says.
    """
    return F.round(value.cast(f"decimal(38,{digits + 4})"), digits).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double; null when ``bottom`` is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a rounded percentage of ``whole``; null when ``whole`` is zero."""
    return rounded(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def money(value: Column) -> Column:
    """Amounts leave the library as double."""
    return value.cast("double")

