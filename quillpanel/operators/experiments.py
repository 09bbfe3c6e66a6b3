"""What leakage looks like: the same pipeline with and without lookahead, nothing stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS, Settings
from quillpanel.functions.numbers import at_least, up_label
from quillpanel.operators import features as FT
from quillpanel.operators import models as M
from quillpanel.operators import sessions as S
from quillpanel.runtime import write_table
from quillpanel.sources.schema import SENTIMENT_FEATURES


def features_at(headlines: DataFrame, sentiment: DataFrame, prices: DataFrame, lag: int, model: str = SETTINGS.model, settings: Settings = SETTINGS) -> DataFrame:
    """The feature table as it would be with ``lag`` extra sessions: attribution is an argument, not a state."""
    placed = S.attribute(headlines.drop("trade_date"), S.calendar(prices), lag=lag).where("trade_date is not null")
    return FT.build_features(prices, FT.daily_sentiment(placed, sentiment, model), settings)


def lag_pivot(results: DataFrame, lags: Sequence[int] = (0, 1)) -> DataFrame:
    """``(model, extra_lag, accuracy, roc_auc)`` to a row per model with a column per metric and lag, and what lag 0 adds."""
    wide = results.groupBy("model").pivot("extra_lag", list(lags)).agg(F.avg("accuracy").alias("accuracy"), F.avg("roc_auc").alias("roc_auc"))
    wide = wide.select("model", *[F.col(f"{lag}_{m}").alias(f"{m}_lag{lag}") for lag in lags for m in ("accuracy", "roc_auc")])
    first, last = lags[0], lags[-1]
    return wide.withColumns({f"{m}_inflation": F.col(f"{m}_lag{first}") - F.col(f"{m}_lag{last}") for m in ("accuracy", "roc_auc")}).orderBy(F.desc("accuracy_inflation"), "model")


def leakage_comparison(headlines: DataFrame, sentiment: DataFrame, prices: DataFrame, lags: Sequence[int] = (0, 1), test_start: str = SETTINGS.test_start, model: str = SETTINGS.model, rounds: int = 200, settings: Settings = SETTINGS) -> DataFrame:
    results = None
    for lag in lags:
        stored = write_table(features_at(headlines, sentiment, prices, lag, model, settings), "features")  # read by every fit
        one = M.ablation(stored, test_start, rounds=rounds).withColumn("extra_lag", F.lit(lag))
        results = one if results is None else results.unionByName(one)
    return lag_pivot(results, lags)


def same_day_leak(features: DataFrame, test_start: str = SETTINGS.test_start, rounds: int = 200) -> DataFrame:
    """``(label, n, accuracy, roc_auc, ...)``: one learner on sentiment alone, asked for the next session's move and for the day's own."""
    out = None
    for label, target, forward in (("next_session", "target_next_up", "fwd_ret_1d"), ("same_day", "_same", "ret_1d")):
        rows = features.withColumn("_same", up_label(F.col("ret_1d"))).where(F.col(target).isNotNull())
        train, test = M.split(rows, test_start)
        trees, _ = M.boosted(train, SENTIMENT_FEATURES, target, rounds=rounds)
        scored = M.boosted_probability(trees, test).withColumn("pred_up", at_least(F.col("prob_up")))
        one = M.evaluate(scored, target, forward=forward)
        one = one.select(F.lit(label).alias("label"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out
