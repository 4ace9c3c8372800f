"""Quantiles from mergeable sketches, with their error against the exact search.

The exact search of ``ranking`` reads the values again for every set of rows. A KLL sketch is kept
per part of the data (a month, a file) and merged for any union of parts, at a rank error that its
size bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 800
# fixed values: the published error of KLL sketches, single-sided at 99 % confidence
ERROR_FACTOR, ERROR_POWER = 2.296, 0.9021


def rank_error(size: int = SIZE) -> float:
    """Share of rows by which a sketched quantile may miss its rank, in 99 of 100 cases."""
    return ERROR_FACTOR / size**ERROR_POWER


def sketches(rows: DataFrame, value: str, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``keys``, rows, sketch of a bigint column; nulls do not count.

    Built on the map side, so a group of any size is shuffled as one sketch per task.
    """
    agg = F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(size)).alias("sketch")
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), agg)


def merged_sketches(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups."""
    return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_quantiles(parts: DataFrame, fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, fraction, sketched: quantiles of the union of the parts in each group."""
    asked = F.array(*[F.lit(float(f)) for f in fractions])
    found = merged_sketches(parts, keys).filter(F.col("rows") > 0)
    values = found.withColumn("_values", F.kll_sketch_get_quantile_bigint("sketch", asked))
    return values.select(*keys, F.posexplode("_values").alias("_at", "sketched")).select(
        *keys, F.element_at(asked, F.col("_at") + 1).alias("fraction"), "sketched"
    )


def measured_error(rows: DataFrame, value: str, quantiles: DataFrame) -> DataFrame:
    """fraction, sketched, error: by what share of the rows each sketched value misses its rank.

    One pass counts the rows below and up to each value; a value whose ranks span the fraction
    has no error. ``quantiles`` is a handful of rows.
    """
    held = [(r.fraction, r.sketched) for r in quantiles.select("fraction", "sketched").collect()]
    if not held:
        return quantiles.select("fraction", "sketched", F.lit(0.0).alias("error"))
    v, total = F.col(value).cast("bigint"), F.count(value)
    spans = [F.struct(F.lit(f).alias("fraction"), F.lit(q).alias("sketched"), (F.count_if(v < q) / total).alias("low"), (F.count_if(v <= q) / total).alias("high")) for f, q in held]
    found = rows.agg(F.array(*spans).alias("_spans")).select(F.inline("_spans"))
    error = F.greatest(F.lit(0.0), F.col("low") - F.col("fraction"), F.col("fraction") - F.col("high"))
    return found.select("fraction", "sketched", error.alias("error"))
