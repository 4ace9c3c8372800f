"""Distinct counts that merge: exact bitmaps of ids per period.

A plain distinct count of customers per month, quarter and year shuffles the ids once for each.
Here the ids of a day become bitmaps, combined on the map side; months, quarters and years are the
OR of their days, and a count is a number of bits. New days are added without reading old lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillgrain.functions import calendar as cal

BITS = 32768
"""Ids in one bitmap, as Spark's bitmap functions fix it."""


def numbered(values: DataFrame, column: str, total: int, bits: int = BITS) -> DataFrame:
    """``column``, _bucket and _position: dense places of distinct values in bitmaps.

    Values are dealt into slots that fill about half a bitmap and counted within them, so no
    window sees more than its slot; a slot that fills more takes further buckets.
    """
    slots = max(1, -(-total // (bits // 2)))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(column)) - 1
    dealt = values.select(column).withColumn("_slot", F.pmod(F.xxhash64(column), F.lit(slots)))
    return dealt.withColumn("_place", place).select(
        column,
        (F.col("_slot") + slots * F.call_function("div", F.col("_place"), F.lit(bits))).alias("_bucket"),
        (F.col("_place") % bits).cast("bigint").alias("_position"),
    )


def id_bitmaps(rows: DataFrame, keys: Sequence[str], ids: str, dictionary: DataFrame | None = None) -> DataFrame:
    """``keys``, _bucket, bits: the ids that occur in each group; null ids do not.

    Whole numbers are their own place, whatever their sign. Other ids need the ``dictionary``
    that :func:`numbered` makes of their distinct values.
    """
    rows = rows.filter(F.col(ids).isNotNull())
    if dictionary is not None:
        rows = rows.select(*keys, ids).join(dictionary, ids)
        bucket, place = F.col("_bucket"), F.col("_position")
    elif isinstance(rows.schema[ids].dataType, T.IntegralType):
        bucket, place = F.bitmap_bucket_number(ids), F.bitmap_bit_position(ids)
    else:
        raise TypeError(f"{ids} is not a whole number; number its values first")
    return rows.groupBy(*keys, bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def merged(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups, or of several tables of the same ids in a union."""
    return bitmaps.groupBy(*keys, "_bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct ids per group of merged bitmaps."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(name))


def period_counts(days: DataFrame, day: str, name: str) -> DataFrame:
    """(level, period, ``name``) for days, months, quarters, years and all time.

    ``days`` holds bitmaps per ``day``; each level is the OR of the one below, so the ids are
    never counted from rows again.
    """
    labels: list[tuple[str, Column]] = [
        ("day", F.date_format(day, "yyyy-MM-dd")),
        ("month", cal.month_label(F.col(day))),
        ("quarter", cal.quarter_label(F.col(day))),
        ("year", F.date_format(day, "yyyy")),
    ]
    names = [n for n, _ in labels]
    level = days.select("_bucket", "bits", *[label.alias(n) for n, label in labels])
    counted = []
    for i in range(len(names) + 1):
        level = merged(level, names[i:])
        period = F.col(names[i]) if i < len(names) else F.lit("all")
        one = distinct_counts(level.withColumn("period", period), ["period"], name)
        counted.append(one.select(F.lit(names[i] if i < len(names) else "all").alias("level"), "period", name))
    result = counted[0]
    for one in counted[1:]:
        result = result.unionByName(one)
    return result
