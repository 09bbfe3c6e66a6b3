"""Small numeric expressions with the edge cases spelled out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def squash(x: Column, k: float) -> Column:
    return 1 / (1 + F.exp(-k * x))


def at_least(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def score_label(score: Column, threshold: float = 0.15) -> Column:
    return F.when(score > threshold, "pos").when(score < -threshold, "neg").when(score.isNotNull(), "neu")


def up_label(forward: Column) -> Column:
    """1 for a positive forward return, else 0; null for null."""
    return (finite(forward) > 0).cast("int")


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns that are not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return ratio(total, n)


def weighted_sum(weights: Mapping[str, float], available: Sequence[str]) -> Column:
    """Sum of weight times column over the columns that exist."""
    parts = [F.lit(w) * F.col(c) for c, w in weights.items() if c in available]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def from_map(values: Column, names: Sequence[str], default: float = 0.0) -> list[Column]:
    """One column per name out of a map, ``default`` where it has none."""
    return [F.coalesce(F.try_element_at(values, F.lit(n)), F.lit(default)).alias(n) for n in names]


def missing_names(values: Column, names: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys(values))
