"""Exact order statistics without sorting the data in one place.

``percentile``/``median`` keep one value-to-count map per group in a single task, and a
window without partitions pulls everything into one. Both fail at billions of customers.
Here a sort key is cut into digits of at most 22 bits. Each pass counts rows per digit below
the prefix that already holds the wanted rank. Counting combines on the map side, a pass
shuffles at most one row per digit value, and only the few wanted prefixes are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGIT_BITS = 22
_MASK = (1 << DIGIT_BITS) - 1

def digits_of(value: Column) -> list[Column]:
    """A bigint as three digits whose lexicographic order is the numeric order."""
    v = value.cast("bigint")
    return [
        F.shiftright(v, 2 * DIGIT_BITS).cast("bigint"),
        F.shiftright(v, DIGIT_BITS).bitwiseAND(F.lit(_MASK).cast("bigint")),
        v.bitwiseAND(F.lit(_MASK).cast("bigint")),
    ]


def value_of(high: Column, mid: Column, low: Column) -> Column:
    """Back from :func:`digits_of`."""
    return F.shiftleft(high, 2 * DIGIT_BITS) + F.shiftleft(mid, DIGIT_BITS) + low


def integer_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def quantile_ranks(bins: int) -> Callable[[Column], Column]:
    """Zero-based ranks of the inner edges of ``bins`` equal-frequency bins.

    An interpolated edge lies in ``[x_lo, x_hi)`` of two neighbouring values, so ``x > edge``
    and ``x > x_lo`` pick the same rows; the lower neighbour is all that is needed.
    """

    def ranks(total: Column) -> Column:
        return F.array(*[integer_div((total - 1) * k, bins) for k in range(1, bins)])

    return ranks


def middle_ranks(total: Column) -> Column:
    """The two ranks whose mean is the median (the same rank twice for odd counts)."""
    return F.array(integer_div(total - 1, 2), integer_div(total, 2))


def order_statistics(
    rows: DataFrame,
    group: str,
    digits: Sequence[str],
    ranks: Callable[[Column], Column],
    weight: str | None = None,
) -> DataFrame:
    """The sort keys at the wanted ranks of every group.

    ``rows`` holds ``group`` (few distinct values), the digit columns (most significant first)
    and optionally a ``weight`` (copies of the row). ``ranks`` maps the group total to an array
    of zero-based ranks. Returns one row ``(group, slot, *digits)`` per wanted rank, where
    ``slot`` is the position in that array.

    ``rows`` is read once per digit, so hand in a materialized table.
    """
    copies = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    lead = [digits[0]]
    in_group = Window.partitionBy(group)
    found = _narrow(
        rows.groupBy(group, *lead)
        .agg(copies.alias("_n"))
        .withColumns(
            {
                "_upto": F.sum("_n").over(in_group.orderBy(*lead).rowsBetween(*so_far)),
                "_total": F.sum("_n").over(in_group),
            }
        )
        .withColumn("_wanted", F.transform(ranks(F.col("_total")), _slot)),
        [group, *lead],
    )
    for depth in range(1, len(digits)):
        prefix = [group, *digits[:depth]]
        held = found.groupBy(*prefix).agg(F.collect_list(F.struct("slot", "rank")).alias("_wanted"))
        within = Window.partitionBy(*prefix).orderBy(digits[depth]).rowsBetween(*so_far)
        found = _narrow(
            rows.join(F.broadcast(held), prefix)  # at most one row per group and rank
            .groupBy(*prefix, "_wanted", digits[depth])
            .agg(copies.alias("_n"))
            .withColumn("_upto", F.sum("_n").over(within)),
            [*prefix, digits[depth]],
        )
    return found.select(group, "slot", *digits)


def _slot(rank: Column, position: Column) -> Column:
    return F.struct(position.alias("slot"), rank.alias("rank"))


def _narrow(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the digit rows that hold a wanted rank, with the rank left inside them."""
    start = F.col("_upto") - F.col("_n")
    inside = F.filter(
        "_wanted", lambda t: (t["rank"] >= start) & (t["rank"] < F.col("_upto"))
    )
    return (
        counted.withColumn("_hit", F.explode(inside))
        .select(*keys, F.col("_hit.slot").alias("slot"), (F.col("_hit.rank") - start).alias("rank"))
    )


def bin_number(key: Column, edges: Column) -> Column:
    """1 + number of edges below ``key``. Repeated edges leave a bin empty, never fail."""
    return F.size(F.filter(edges, lambda edge: key > edge)) + 1
