"""The whole pipeline over a store, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS, Settings
from quillpanel.operators import analysis, experiments, scoring
from quillpanel.operators import features as FT
from quillpanel.operators import headlines as HL
from quillpanel.operators import models as M
from quillpanel.operators import monitor as MO
from quillpanel.runtime import write_table
from quillpanel.sources.schema import KEYS
from quillpanel.sources.writers import Store, backfilled, numbered


def init(store: Store, drop: bool = False) -> None:
    for table in KEYS:
        store.create(table, drop)


def ingest_prices(store: Store, prices: DataFrame) -> DataFrame:
    """Rows with an adjusted close, upserted."""
    return store.upsert("prices", prices.where("adj_close is not null"), KEYS["prices"])


def ingest_headlines(store: Store, raw: DataFrame, tickers: list[str], settings: Settings = SETTINGS) -> DataFrame:
    """Replaces the headlines of ``tickers``: changed rules leave nothing of an earlier run behind."""
    rows = HL.ingest(raw.where(F.col("ticker").isin(tickers)), store.read("prices"), settings.extra_lag_sessions, settings.start_date, settings.end_date)
    return store.replace_keys("headlines", rows, "ticker", tickers)


def score(store: Store, make: Callable[[], scoring.Scorer] = scoring.LexiconScorer, limit: int | None = None, settings: Settings = SETTINGS, batch: int = 64) -> DataFrame:
    """Scores what has no row of the model yet."""
    todo = HL.unscored(store.read("headlines"), store.read("sentiment"), settings.model, limit)
    return store.upsert("sentiment", scoring.score(todo, settings.model, make, batch=batch), KEYS["sentiment"])


def build_features(store: Store, settings: Settings = SETTINGS) -> DataFrame:
    daily = FT.daily_sentiment(store.read("headlines"), store.read("sentiment"), settings.model)
    return store.write("features", FT.build_features(store.read("prices"), daily, settings))


def analyse(store: Store, settings: Settings = SETTINGS) -> dict[str, DataFrame]:
    f = store.read("features")
    study = analysis.lead_lag(store.read("headlines"), store.read("sentiment"), store.read("prices"), settings.model)
    study = write_table(study, "lead_lag")  # seven rows, which the peak reads too
    return {"lead_lag": study, "peak": analysis.peak(study), "ic": analysis.information_coefficient(f), "buckets": analysis.buckets(f)}


def train(store: Store, settings: Settings = SETTINGS, rounds: int = 200) -> DataFrame:
    """Ablation metrics; the best model and the best on all features are stored, with their predictions and the metrics.

    The best on all features is the one that is served: it lies in ``models/combined``.
    """
    features, kept = store.read("features"), {}
    metrics = M.ablation(features, settings.test_start, rounds=rounds, kept=kept)
    results = metrics.collect()  # nine rows
    metrics = store.spark.createDataFrame(results, metrics.schema)
    fit, test = M.split(features, settings.test_start)
    best = [M.champion(metrics).first(), M.champion(metrics, like="combined").first()]  # two rows
    strength = {r["model"]: r["C"] for r in best}
    out = None
    for name in sorted(strength):
        learner, _, block = name.partition("__")
        if learner == "logreg":
            model = kept.get(name) or M.logistic(fit, M.BLOCKS[block], c=strength[name])
            scored = test.withColumn("prob_up", model.probability())
        elif learner == "hgb":
            model = kept.get(name) or M.boosted(fit, M.BLOCKS[block], rounds=rounds)[0]
            scored = M.boosted_probability(model, test)
        else:
            scored = M.baselines(fit, test).where(F.col("model") == name).drop("model", "pred_up")
        if learner in ("logreg", "hgb"):
            M.save_bundle(store.spark, f"{store.root}/models/{name}", name, M.BLOCKS[block], model)
            if name == best[1]["model"]:
                M.save_bundle(store.spark, f"{store.root}/models/combined", name, M.BLOCKS[block], model)
        rows = M.predictions(scored, name)
        out = rows if out is None else out.unionByName(rows)
    store.write("predictions", out)
    store.put_json("metrics", {"champion": best[0]["model"], "combined": best[1]["model"] if best[1] else None, "test_start": settings.test_start, "results": [r.asDict() for r in results]})
    return metrics


def monitor(store: Store, model: str | None = None, settings: Settings = SETTINGS) -> list[dict]:
    """Fills in outcomes, checks each model and appends what it found to the log."""
    predictions = store.write("predictions", backfilled(store.read("predictions"), store.read("features")))
    checks = MO.check_drift(predictions if model is None else predictions.where(F.col("model") == model), store.read("features"), window=settings.monitor_window, test_start=settings.test_start)
    rows = [r.asDict() for r in checks.orderBy("model").collect()]  # a row a model
    known = [r for r in rows if r["status"] != "NO_DATA"]
    if known:
        log = store.create("monitor_log")
        fields = [c for c in log.columns if c not in ("id", "created_at")]
        new = store.spark.createDataFrame([tuple(r[c] for c in fields) for r in known], log.select(*fields).schema)
        store.append("monitor_log", numbered(new, log, ["model"]).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).select(*log.columns))
    return rows


def experiment(store: Store, settings: Settings = SETTINGS, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    h, s, p = store.read("headlines"), store.read("sentiment"), store.read("prices")
    return (
        experiments.leakage_comparison(h, s, p, test_start=settings.test_start, model=settings.model, rounds=rounds, settings=settings),
        experiments.same_day_leak(experiments.features_at(h, s, p, 0, settings.model, settings), settings.test_start, rounds),
    )
