"""Within-day ranking: z-scores, labels, information coefficients, long-short returns.

A day's cross-section is bounded by the number of tickers, so windows by date
are; all of them share one exchange by date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions.numbers import ratio, row_mean, weighted_sum
from quillpanel.functions.stats import average_rank, exact_quantiles, group_medians, guarded_corr
from quillpanel.runtime import write_table


def _day() -> WindowSpec:
    return Window.partitionBy("date")


def panel(features: DataFrame, least: int = SETTINGS.min_names_per_day) -> DataFrame:
    """Feature rows of days with at least ``least`` names."""
    return features.withColumn("_names", F.count("*").over(_day())).where(F.col("_names") >= least).drop("_names")


def _z(c: Column) -> Column:
    return F.coalesce(ratio(c - F.avg(c).over(_day()), F.nullif(F.stddev_samp(c).over(_day()), F.lit(0.0))), F.lit(0.0))


def zscored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by their z-score within the day; 0 for null and where all are equal."""
    return df.withColumns({c: _z(F.col(c)) for c in columns})


def with_composite(df: DataFrame, parts: Sequence[str] = SETTINGS.composite) -> DataFrame:
    """``sent_composite``: the mean of the z-scored parts, z-scored again."""
    have = [F.col(c) for c in parts if c in df.columns]
    return df.withColumn("_mean", row_mean(have)).withColumn("sent_composite", _z(F.col("_mean"))).drop("_mean")


def with_relative_target(df: DataFrame, forward: str = "fwd_ret_1d") -> DataFrame:
    """``fwd_ret_rel`` (less the day's median) and ``target_rel``: 1 for the upper half of the day, 0 for the lower.

    Ties are ordered by ticker. On a day with an odd number of names the middle
    one is left out, so the halves are equal.
    """
    order = _day().orderBy(forward, "ticker")
    ranked = df.withColumns({"fwd_ret_rel": F.col(forward) - F.median(forward).over(_day()), "_rn": F.row_number().over(order), "_n": F.count("*").over(_day())})
    even = ranked.where((F.col("_n") % 2 == 0) | (F.col("_rn") != (F.col("_n") + 1) / 2))
    half = even.withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(_day())})
    return half.withColumn("target_rel", (F.col("_rn") > F.col("_n") / 2).cast("int")).drop("_rn", "_n")


def prior_score(df: DataFrame, signs: Mapping[str, float] = SETTINGS.sign_prior) -> DataFrame:
    """``prior``: the signed sum of the columns the prior names, of those there are."""
    return df.withColumn("prior", weighted_sum(signs, df.columns))


def daily_ic(df: DataFrame, score: str, forward: str = "fwd_ret_1d", least: int = SETTINGS.min_names_per_day, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, date, ic)``: the day's rank correlation; no row for days with few names, fewer than two returns, or a constant side."""
    keys = [*by, "date"]
    whole = df.select(*keys, F.col(score).alias("_s"), F.col(forward).alias("_r")).where("_s is not null and _r is not null")
    ranked = whole.withColumns({"_rs": average_rank(F.col("_s"), keys), "_rr": average_rank(F.col("_r"), keys)})
    days = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct("_r").alias("_d"), guarded_corr(F.col("_rs"), F.col("_rr")).alias("ic"))
    return days.where((F.col("_n") >= least) & (F.col("_d") >= 2) & F.col("ic").isNotNull()).select(*keys, "ic")


def ic_summary(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, mean_ic, ic_std, ic_t, share_positive, n_days)``; nulls and 0 for no days."""
    s = ic.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.count("ic").alias("n_days"))
    t = F.when(F.col("ic_std") > 0, ratio(F.col("mean_ic"), F.col("ic_std") / F.sqrt("n_days")))
    return s.select(*by, "mean_ic", "ic_std", t.alias("ic_t"), "share_positive", "n_days")


def legs(df: DataFrame, score: str, n_side: int | None = None, forward: str = "fwd_ret_1d", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, date, ticker, w, ret)``: equal weights on the day's best and worst names.

    ``k`` a side is ``n_side``, else a quarter of the names, two at least; days
    with fewer than ``2 k`` names have no position. Ties are ordered by ticker.
    """
    own_day = Window.partitionBy(*by, "date")
    order = own_day.orderBy(F.col(score), "ticker")
    rows = df.where(F.col(score).isNotNull()).select(*by, "date", "ticker", F.col(score), F.col(forward).alias("ret"), F.row_number().over(order).alias("_rn"), F.count("*").over(own_day).alias("_n"))
    k = F.lit(n_side) if n_side else F.greatest(F.lit(2), F.floor(F.col("_n") / 4))
    rows = rows.withColumn("_k", k).where(F.col("_n") >= 2 * F.col("_k"))
    side = F.when(F.col("_rn") <= F.col("_k"), -1.0).when(F.col("_rn") > F.col("_n") - F.col("_k"), 1.0)
    return rows.withColumn("w", side / F.col("_k")).where("w is not null").select(*by, "date", "ticker", "w", "ret")


def long_short(df: DataFrame, score: str, n_side: int | None = None, cost_bps: float = SETTINGS.cost_bps_per_side, forward: str = "fwd_ret_1d", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, date, gross, turnover, cost, net)`` per traded day.

    Turnover is half the sum of weight changes against the last traded day, and
    1 on the first. Each weight counts on its day and, negated, on the next: one
    aggregate instead of a day-by-day loop.
    """
    pos = legs(df, score, n_side, forward, by)
    days = pos.select(*by, "date").distinct().withColumn("_d", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")))  # one row a day
    placed = pos.join(F.broadcast(days), [*by, "date"])
    moves = placed.select(*by, "_d", "ticker", "w").unionByName(placed.select(*by, (F.col("_d") + 1).alias("_d"), "ticker", (-F.col("w")).alias("w")))
    turnover = moves.groupBy(*by, "_d", "ticker").agg(F.sum("w").alias("dw")).groupBy(*by, "_d").agg((F.sum(F.abs("dw")) / 2).alias("turnover"))
    gross = pos.groupBy(*by, "date").agg((F.avg(F.when(F.col("w") > 0, F.col("ret"))) - F.avg(F.when(F.col("w") < 0, F.col("ret")))).alias("gross"))
    out = gross.join(F.broadcast(days), [*by, "date"]).join(turnover, [*by, "_d"]).withColumn("turnover", F.when(F.col("_d") == 1, 1.0).otherwise(F.col("turnover")))
    cost = F.col("turnover") * cost_bps / 1e4 * 2
    return out.select(*by, "date", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def backtest_stats(days: DataFrame, cost_bps: float = SETTINGS.cost_bps_per_side, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): days, returns in bps a day, yearly Sharpe ratios (0 for no spread), turnover, cost, share of winning days."""
    sharpe = lambda c: F.coalesce(F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(252.0))), F.lit(0.0))
    return days.groupBy(*by).agg(
        F.count("*").alias("n_days"), (1e4 * F.avg("gross")).alias("gross_bps_per_day"), (1e4 * F.avg("net")).alias("net_bps_per_day"),
        sharpe("gross").alias("gross_sharpe"), sharpe("net").alias("net_sharpe"), F.avg("turnover").alias("avg_turnover"),
        (1e4 * F.avg("cost")).alias("cost_bps_day"), F.lit(float(cost_bps)).alias("cost_bps_per_side"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
    )


def cumulative(days: DataFrame) -> DataFrame:
    """``(date, cum_gross, cum_net)``: compounded returns. One row a day."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("date", (F.product(1 + F.col("gross")).over(w) - 1).alias("cum_gross"), (F.product(1 + F.col("net")).over(w) - 1).alias("cum_net"))


def accuracy(df: DataFrame, score: str, target: str = "target_rel", cut: float | None = 0.5) -> DataFrame:
    """``(accuracy, n)`` of ``score >= cut`` against ``target``; ``cut=None`` takes the score's median."""
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    if cut is None:
        rows = write_table(rows.select(F.col(score), F.col(target)), "scored")
        cut = next(iter(exact_quantiles(rows.where(~F.isnan(score)), score, [0.5])), None)
    hit = (F.col(score) >= F.lit(cut)).cast("int") == F.col(target)
    return rows.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def compared(scored: DataFrame, cuts: Mapping[str, float | None], least: int = SETTINGS.min_names_per_day, cost_bps: float = SETTINGS.cost_bps_per_side) -> DataFrame:
    """A row per model of ``cuts``, in its order: accuracy, IC summary and back-test, as ``accuracy``, ``ic_summary`` and ``backtest_stats`` have them.

    ``scored`` is stored and has ``model, date, ticker, score, target_rel, fwd_ret_1d``; all models share each exchange.
    """
    by = ["model"]
    models = scored.sparkSession.createDataFrame([(k, m, c) for k, (m, c) in enumerate(cuts.items())], "_k int, model string, _cut double")  # a row a model
    known = F.col("score").isNotNull() & F.col("target_rel").isNotNull()
    of_median = [m for m, c in cuts.items() if c is None]
    if of_median:
        middle = group_medians(scored.where(known & F.col("model").isin(of_median) & ~F.isnan("score")), "model", "score")
        models = models.join(middle, "model", "left").select("_k", "model", F.coalesce("_cut", "median").alias("_cut"))
    hit = (F.col("score") >= F.col("_cut")).cast("int") == F.col("target_rel")
    right = scored.where(known).join(F.broadcast(models), "model").groupBy("model").agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))
    ic = ic_summary(daily_ic(scored, "score", least=least, by=by), by).withColumnRenamed("n_days", "ic_days")
    traded = backtest_stats(long_short(scored, "score", cost_bps=cost_bps, by=by), cost_bps, by)
    none = {"n": 0, "ic_days": 0, "n_days": 0, "gross_sharpe": 0.0, "net_sharpe": 0.0, "cost_bps_per_side": float(cost_bps)}  # what no rows give
    out = models.select("_k", "model").join(right, "model", "left").join(ic, "model", "left").join(traded, "model", "left")
    return out.orderBy("_k").select("model", *[F.coalesce(c, F.lit(none[c]).cast(out.schema[c].dataType)).alias(c) if c in none else c for c in [*right.columns[1:], *ic.columns[1:], *traded.columns[1:]]])
