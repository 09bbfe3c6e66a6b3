"""Daily sentiment and the feature panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS, Settings
from quillpanel.functions.numbers import up_label
from quillpanel.functions.windows import change, ewma, forward_change, rolling_mean, rolling_std, rolling_z
from quillpanel.sources.schema import FEATURES


def daily_sentiment(headlines: DataFrame, sentiment: DataFrame, model: str = SETTINGS.model) -> DataFrame:
    """Per ticker and session: headlines with a score of ``model``, mean and population deviation of the score, shares of the labels."""
    scored = headlines.select("headline_uid", "ticker", "trade_date").join(sentiment.where(F.col("model") == model).select("headline_uid", "score", "label"), "headline_uid")
    is_ = lambda label: F.avg(F.when(F.col("label") == label, 1.0).otherwise(0.0))
    day = scored.groupBy("ticker", F.col("trade_date").alias("date")).agg(
        F.count("*").cast("double").alias("n_headlines"), F.avg("score").alias("sent_mean"), F.avg(F.col("score") * F.col("score")).alias("_sq"),
        is_("pos").alias("sent_pos_frac"), is_("neg").alias("sent_neg_frac"),
    )
    return day.withColumns({
        "sent_std": F.sqrt(F.greatest(F.col("_sq") - F.col("sent_mean") * F.col("sent_mean"), F.lit(0.0))),
        "sent_net": F.col("sent_pos_frac") - F.col("sent_neg_frac"),
    }).drop("_sq")


def panel(prices: DataFrame, daily: DataFrame) -> DataFrame:
    """Every price row with its day's sentiment; a quiet day has 0 headlines and null sentiment."""
    joined = prices.select("ticker", "date", "adj_close", "volume").join(daily, ["ticker", "date"], "left")
    return joined.withColumn("n_headlines", F.coalesce("n_headlines", F.lit(0.0)))


def with_windows(df: DataFrame) -> DataFrame:
    """The windowed features and the forward label over a whole panel, warm-up included.

    One exchange by ticker serves all windows. The weighted mean runs over days
    with news only: it is computed in a partition of its own, (ticker, news or
    not), which the same exchange satisfies.
    """
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    has_news = F.col("sent_mean").isNotNull()
    news = Window.partitionBy("ticker", has_news).orderBy("date")
    first = df.repartition("ticker").withColumns({
        "ret_1d": change(F.col("adj_close"), by_ticker), "ret_5d": change(F.col("adj_close"), by_ticker, 5),
        "_sma10": rolling_mean(F.col("adj_close"), by_ticker, 10, 5), "_sma30": rolling_mean(F.col("adj_close"), by_ticker, 30, 10),
        "sent_surprise": F.col("sent_mean") - rolling_mean(F.col("sent_mean"), by_ticker, 10, 3),
        "news_vol_z": rolling_z(F.col("n_headlines"), by_ticker, 20, 5), "volume_z": rolling_z(F.col("volume"), by_ticker, 20, 5),
        "fwd_ret_1d": forward_change(F.col("adj_close"), by_ticker),
    })
    second = first.withColumns({
        "vol_5d": rolling_std(F.col("ret_1d"), by_ticker, 5, 3),
        "ma_gap": F.try_divide("adj_close", "_sma10") - 1, "ma_cross": F.try_divide(F.col("_sma10") - F.col("_sma30"), F.col("_sma30")),
        "target_next_up": up_label(F.col("fwd_ret_1d")),
    })
    return second.withColumn("sent_ewma3", F.when(has_news, ewma(F.col("sent_mean"), news))).drop("_sma10", "_sma30")


def build_features(prices: DataFrame, daily: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The feature table: windows over everything, then universe, dates, news and complete rows."""
    rows = with_windows(panel(prices, daily))
    if settings.tickers:
        rows = rows.where(F.col("ticker").isin(*settings.tickers))
    rows = rows.where(F.col("date").between(F.lit(settings.start_date).cast("date"), F.lit(settings.end_date).cast("date")) & (F.col("n_headlines") >= settings.min_headlines_per_day))
    return rows.dropna(subset=[*FEATURES, "target_next_up"]).select("ticker", "date", *FEATURES, "fwd_ret_1d", "target_next_up")
