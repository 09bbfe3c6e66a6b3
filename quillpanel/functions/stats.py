"""Rank statistics, tests and stability measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpanel.functions.numbers import finite, ratio
from quillpanel.runtime import write_table


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side is constant."""
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank within groups of bounded size, ties sharing their mean rank."""
    same = Window.partitionBy(*by, x)
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(same) - 1) / 2


#: Different values in a range that one task puts in order.
VALUES_PER_RANGE = 500_000


def ordered_counts(df: DataFrame, by: str | Sequence[str], column: str, values_per_range: int = VALUES_PER_RANGE, more: Sequence[Column] = ()) -> DataFrame:
    """``(*by, column, *more, _n, _upto)``: each value of each group with its rows, aggregates ``more`` of them, and the rows of the group up to and with it.

    No task sorts a whole group: values are exchanged into ranges, as many as
    their number asks for, and what lies in ranges before comes from the ranges'
    totals. A value that many rows share is one row, map-side combined.
    """
    keys = [by] if isinstance(by, str) else list(by)
    counts = write_table(df.groupBy(*keys, column).agg(*more, F.count("*").alias("_n")), "counts")
    kept = counts.columns
    ranges = max(1, -(-counts.count() // values_per_range))
    if ranges == 1:  # nothing lies before
        return counts.select(*kept, F.sum("_n").over(Window.partitionBy(*keys).orderBy(column)).alias("_upto"))
    ranged = write_table(counts.repartitionByRange(ranges, *keys, column).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(column))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))
    before = totals.select(*keys, "_range", (F.sum("_total").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_total")).alias("_before"))  # a row per group and range
    return ranged.withColumn("_inside", inside).join(before, [*keys, "_range"]).select(*kept, (F.col("_before") + F.col("_inside")).alias("_upto"))


def pooled_ranks(df: DataFrame, by: str | Sequence[str], column: str, out: str, values_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """``(*by, column, out)``: the average rank of each value among all rows of the same ``by``, whatever their number."""
    counts = ordered_counts(df, by, column, values_per_range)
    return counts.select(*counts.columns[:-2], (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def with_pooled_rank(df: DataFrame, by: str, column: str, out: str, values_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """``df`` with ``pooled_ranks`` joined. ``df`` is read twice: give a stored table."""
    return df.join(pooled_ranks(df, by, column, out, values_per_range), [by, column])


def rank_sums(df: DataFrame, by: str, column: str, own: Column, values_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """``(by, r, p, n)``: the sum of the average ranks of the rows where ``own`` holds, their number, and that of all rows.

    From the counts per value: ranks are not joined to the rows.
    """
    counts = ordered_counts(df, by, column, values_per_range, [F.count(F.when(own, 1)).alias("_own")])
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    return counts.groupBy(by).agg(F.sum(F.when(F.col("_own") > 0, F.col("_own") * rank)).alias("r"), F.sum("_own").alias("p"), F.sum("_n").alias("n"))


def with_place(df: DataFrame, order: Sequence[str], out: str, rows_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """``df``, a stored table, with each row's place from 1 on in ``order``: ranges of rows, and prefix sums over the ranges.

    Rows that share a value of the first column are split by the others.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    if ranges == 1:  # no more rows than one task puts in order
        return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    ranged = write_table(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "placed")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_total")).alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_within", place).join(before, "_range").withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float], values_per_range: int = VALUES_PER_RANGE) -> list[float]:
    """Quantiles of a column without nulls, interpolated between neighbours; none for no rows.

    Only the values at the places asked for, two a quantile, come to the driver.
    """
    counts = ordered_counts(df.select(F.lit(0).alias("_all"), F.col(column).alias("_v")), "_all", "_v", values_per_range)
    total = counts.agg(F.max("_upto")).first()[0]
    if not total:
        return []
    wanted = [(total - 1) * q for q in at]
    places = sorted({int(math.floor(w)) for w in wanted} | {int(math.ceil(w)) for w in wanted})
    held = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_n")))
    value = {r["p"]: float(r["_v"]) for r in counts.select("_v", F.explode(held).alias("p")).collect()}
    out = []
    for w in wanted:
        lo, hi = math.floor(w), math.ceil(w)
        out.append(value[lo] if value[lo] == value[hi] else (hi - w) * value[lo] + (w - lo) * value[hi])
    return out


def group_medians(df: DataFrame, by: str, column: str, values_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """``(by, median)`` of a column without nulls, interpolated between the two in the middle, of all groups at once."""
    counts = ordered_counts(df, by, column, values_per_range)
    totals = counts.groupBy(by).agg(F.max("_upto").alias("_of"))  # a row a group
    at = lambda place: F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col(column)))
    lower, upper = at(F.floor((F.col("_of") + 1) / 2)), at(F.floor(F.col("_of") / 2) + 1)
    return counts.join(totals, by).groupBy(by).agg(F.when(lower == upper, lower).otherwise(lower / 2 + upper / 2).alias("median"))


def pooled_spearman(pairs: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``(by, rho, n)``: Spearman correlation per group over all its pairs; pairs with a null are left out before ranking.

    The pairs, three columns, are stored once in the shared folder: ranking reads them several times.
    """
    whole = write_table(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).alias("_x"), F.col(y).alias("_y")), "pairs")
    if whole.schema["_x"].dataType == whole.schema["_y"].dataType:  # both sides are ranked in one go
        side = lambda k, c: F.struct(F.lit(k).alias("_side"), F.col(c).alias("_v"))
        ranks = pooled_ranks(whole.select(by, F.explode(F.array(side(0, "_x"), side(1, "_y"))).alias("_s")).select(by, "_s.*"), [by, "_side"], "_v", "_r")
        rx, ry = (ranks.where(F.col("_side") == k).select(by, F.col("_v").alias(f"_{c}"), F.col("_r").alias(f"_r{c}")) for k, c in enumerate("xy"))
    else:
        rx, ry = pooled_ranks(whole, by, "_x", "_rx"), pooled_ranks(whole, by, "_y", "_ry")
    ranked = whole.join(rx, [by, "_x"]).join(ry, [by, "_y"])
    return ranked.groupBy(by).agg(guarded_corr(F.col("_rx"), F.col("_ry")).alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation under Student's t with n - 2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / ((1 - rho) * (1 + rho))
    return math.exp(_log_beta_share(df / 2, 0.5, df / (df + t2)))


def _log_beta_share(a: float, b: float, x: float) -> float:
    """Log of the regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_fraction(a, b, x)) - math.log(a)
    return math.log1p(-math.exp(front) * _fraction(b, a, 1 - x) / b)


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


@F.pandas_udf(T.DoubleType())
def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """``spearman_p`` over the few rows of a report."""
    return pd.Series([spearman_p(None if pd.isna(r) else float(r), int(k)) for r, k in zip(rho, n)], dtype="float64")


def quantile_bucket(place: Column, n: Column, q: int) -> Column:
    """Which of ``q`` equally filled buckets the row in ``place`` (from 1) of ``n`` lies in."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.call_function("div", (place - 1) * q + n - 2, n - 1))).cast("int")


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """``(psi)``, or ``(by, psi)``: population stability index of ``column`` between ``expected`` and ``actual``, or each group of it.

    Bins end at the distinct quantiles of ``expected`` (exact, by linear
    interpolation), open at both ends. Null where either side has fewer finite
    values than bins, or there are fewer than three edges.
    """
    keys = [by] if by else []
    e = write_table(expected.select(finite(F.col(column).cast("double")).alias("x")).where("x is not null"), "expected")
    a = actual.select(*keys, finite(F.col(column).cast("double")).alias("x")).where("x is not null")
    edges = list(dict.fromkeys(exact_quantiles(e, "x", [i / bins for i in range(bins + 1)])))
    n_bins = max(1, len(edges) - 1)
    inner = F.array(*[F.lit(v) for v in edges[1:-1]]).cast("array<double>")
    place = F.size(F.filter(inner, lambda v: v <= F.col("x")))
    counts = [F.count(F.when(place == k, 1)).alias(f"_{k}") for k in range(n_bins)]
    base = list(e.agg(*counts).first())
    n_base, n = sum(base), sum((F.col(f"_{k}") for k in range(n_bins)), F.lit(0))
    if n_base < bins or len(edges) < 3:
        return a.groupBy(*keys).agg(F.lit(None).cast("double").alias("psi"))
    terms = F.lit(0.0)
    for k in range(n_bins):
        was, now = max(base[k] / n_base, 1e-6), F.greatest(ratio(F.col(f"_{k}"), n), F.lit(1e-6))
        terms = terms + (now - was) * F.log(now / was)
    return a.groupBy(*keys).agg(*counts).select(*keys, F.when(n >= bins, terms).alias("psi"))
