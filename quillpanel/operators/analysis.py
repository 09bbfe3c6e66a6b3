"""Does the signal lead or follow: lead-lag, information coefficient, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions.stats import p_value, pooled_spearman, quantile_bucket, with_place
from quillpanel.functions.windows import change
from quillpanel.operators import sessions as S
from quillpanel.runtime import write_table


def daily_news(headlines: DataFrame, sentiment: DataFrame, model: str, least: int = 3) -> DataFrame:
    """``(ticker, news_date, sent, n)`` per UTC day of publication with at least ``least`` scored headlines.

    Means are rounded to 12 places, so that equal ones tie whatever order they were summed in.
    """
    scored = headlines.select("headline_uid", "ticker", "published_at").join(sentiment.where(F.col("model") == model).select("headline_uid", "score"), "headline_uid")
    return scored.groupBy("ticker", F.to_date("published_at").alias("news_date")).agg(F.round(F.avg("score"), 12).alias("sent"), F.count("score").alias("n")).where(F.col("n") >= least)


def lead_lag_pairs(news: DataFrame, prices: DataFrame, max_lag: int = 3) -> DataFrame:
    """``(lag_k, sent, ret)``: the news of a day against the ticker's return ``k`` sessions from it, along the common calendar."""
    cal = S.calendar(prices)
    returns = prices.select("ticker", F.col("date").alias("session"), change(F.col("adj_close"), Window.partitionBy("ticker").orderBy("date")).alias("ret")).where("ret is not null")
    numbered = returns.join(F.broadcast(cal), "session").select("ticker", "idx", "ret")  # the calendar: one row a trading day
    placed = S.with_session_index(news, F.col("news_date"), cal, "at")
    shifted = placed.select("ticker", "sent", "at", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag_k"))
    return shifted.select("ticker", "sent", "lag_k", (F.col("at") + F.col("lag_k")).alias("idx")).join(numbered, ["ticker", "idx"]).select("lag_k", "sent", "ret").where("sent is not null")


def lead_lag(headlines: DataFrame, sentiment: DataFrame, prices: DataFrame, model: str, least: int = 3, max_lag: int = 3) -> DataFrame:
    """``(lag_k, spearman, p_value, n)`` for each lag."""
    pairs = lead_lag_pairs(daily_news(headlines, sentiment, model, least), prices, max_lag)
    return pooled_spearman(pairs, "lag_k", "sent", "ret").select("lag_k", F.col("rho").alias("spearman"), p_value("rho", "n").alias("p_value"), "n")


def peak(study: DataFrame) -> DataFrame:
    """``(lag_k, verdict)``: where the correlation is highest; at 0 the news follows the move."""
    top = study.agg(F.max_by("lag_k", "spearman").alias("lag_k"))
    return top.withColumn("verdict", F.when(F.col("lag_k") == 0, "CONTEMPORANEOUS").otherwise("predictive"))


def information_coefficient(features: DataFrame, feature: str = "sent_mean", forward: str = "fwd_ret_1d") -> DataFrame:
    """``(period, ic, p_value, n)`` over all rows and per year, ranks taken within each period."""
    pairs = features.select(F.explode(F.array(F.lit("ALL"), F.year("date").cast("string"))).alias("period"), F.col(feature).alias("x"), F.col(forward).alias("y"))
    return pooled_spearman(pairs, "period", "x", "y").select("period", F.col("rho").alias("ic"), p_value("rho", "n").alias("p_value"), "n")


def buckets(features: DataFrame, feature: str = "sent_mean", q: int = 5) -> DataFrame:
    """``(bucket, n, mean_fwd_ret_bps, hit_rate, mean_sentiment)`` over ``q`` buckets of equal number.

    Ties are put in order by date and ticker. Places come from ranges of rows in
    that order, so no task orders the whole panel, nor all rows of one value.
    """
    rows = features.where(F.col(feature).isNotNull() & F.col("fwd_ret_1d").isNotNull()).select("ticker", "date", F.col(feature).alias("_x"), "fwd_ret_1d", "target_next_up")
    rows = write_table(rows, "bucketed")
    placed = with_place(rows, ["_x", "date", "ticker"], "_place").withColumn("_n", F.lit(rows.count()))
    return placed.groupBy(F.concat(F.lit("Q"), quantile_bucket(F.col("_place"), F.col("_n"), q)).alias("bucket")).agg(
        F.count("*").alias("n"), (1e4 * F.avg("fwd_ret_1d")).alias("mean_fwd_ret_bps"), F.avg("target_next_up").alias("hit_rate"), F.avg("_x").alias("mean_sentiment")
    )


def coverage(headlines: DataFrame) -> DataFrame:
    """``(ticker, month, n)`` of attributed headlines."""
    return headlines.groupBy("ticker", F.trunc("trade_date", "month").alias("month")).agg(F.count("*").alias("n"))


def well_covered(headlines: DataFrame, month_share: float = 0.8, least: int = 1200, months: int | None = None) -> DataFrame:
    """Tickers with news in enough months and enough news in all; ``months`` is the number of months there are."""
    per = coverage(headlines).groupBy("ticker").agg(F.sum("n").alias("n_headlines"), F.count("*").alias("n_months"))
    of = headlines.agg(F.count_distinct(F.trunc("trade_date", "month"))).scalar() if months is None else F.lit(months)
    return per.withColumn("_months", of).where((F.col("n_months") >= month_share * F.col("_months")) & (F.col("n_headlines") >= least)).drop("_months")
