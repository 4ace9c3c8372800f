"""Calendar expressions. All are independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(when: Column) -> Column:
    """``yyyy-MM``"""
    return F.substring(F.to_date(when).cast("string"), 1, 7)


def month_index(when: Column) -> Column:
    """Months on one integer scale, so that consecutive months differ by one."""
    return F.year(when) * 12 + F.month(when)


def label_of_index(index: Column) -> Column:
    """Back from :func:`month_index` to ``yyyy-MM``."""
    zero_based = index - 1
    return F.concat(
        F.floor(zero_based / 12).cast("string"),
        F.lit("-"),
        F.lpad((zero_based % 12 + 1).cast("string"), 2, "0"),
    )


def quarter_label(when: Column) -> Column:
    """``yyyy-Qn``"""
    return F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string"))


def weekday(when: Column) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(F.to_date(when))


def weekend_flag(when: Column) -> Column:
    return (weekday(when) >= 5).cast("int")


def month_name(day: Column) -> Column:
    return F.date_format(F.to_date(day), "MMMM")


def day_name(day: Column) -> Column:
    return F.date_format(F.to_date(day), "EEEE")


def whole_days(earlier: Column, later: Column) -> Column:
    """Full 24-hour spans from ``earlier`` to ``later`` (not calendar days)."""
    return F.extract(F.lit("DAY"), later - earlier)


def plus_days(when: Column, days: int) -> Column:
    return when + F.make_dt_interval(days=F.lit(days))
