"""Labels from thresholds, fixed edges and rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillgrain.config import Ladder


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """Label of the first condition that holds."""
    label = F.lit(otherwise)
    for condition, name in reversed(rules):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return label


def at_least(value: Column, ladder: Ladder) -> Column:
    return first_match([(value >= s.bound, s.label) for s in ladder.steps], ladder.otherwise)


def at_most(value: Column, ladder: Ladder) -> Column:
    return first_match([(value <= s.bound, s.label) for s in ladder.steps], ladder.otherwise)


def between_edges(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edge, next edge]``; null outside all of them."""
    bins = zip(edges[:-1], edges[1:], labels, strict=True)
    return first_match([((value > lo) & (value <= hi), name) for lo, hi, name in bins], None)


def shorten(text: Column, width: int) -> Column:
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))
    ).otherwise(text)
