"""What the HTTP endpoints answer, as functions of a session and a store: a long-lived session is the server."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.operators import models as M
from quillpanel.operators import monitor as MO
from quillpanel.sources.writers import Store

#: Rows of a list answer at most.
MAX_LIMIT = 5000


class NotReady(LookupError):
    """Nothing trained or computed yet (an HTTP server would say 503)."""


class NotFound(LookupError):
    """No such thing (404)."""


def health(headlines: DataFrame, features: DataFrame) -> DataFrame:
    """``(n_headlines, n_features)`` in one row."""
    return headlines.agg(F.count("*").alias("n_headlines")).withColumn("n_features", features.agg(F.count("*")).scalar())


def whole_health(headlines: DataFrame, features: DataFrame, model_name: str | None, prices: DataFrame) -> dict:
    """The counts, whether a model is loaded and which, and the tickers there are (the universe, a short list)."""
    n = health(headlines, features).first()
    tickers = [r[0] for r in prices.select("ticker").distinct().orderBy("ticker").collect()]
    return {"status": "ok", "model_loaded": model_name is not None, "model_name": model_name, "tickers": tickers, **n.asDict()}


def features_schema(model_name: str | None, columns: list[str]) -> dict:
    if model_name is None:
        raise NotReady("no model")
    return {"model": model_name, "features": columns}


def _limit(n: int) -> int:
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
    return n


def signal(features: DataFrame, prices: DataFrame, ticker: str | None = None, limit: int = 200) -> DataFrame:
    """The newest feature rows with their close, of one ticker (any letter case) or of all; of a day in ticker order."""
    rows = features.join(prices.select("ticker", "date", "adj_close"), ["ticker", "date"])
    if ticker:
        rows = rows.where(F.col("ticker") == ticker.strip().upper())
    return rows.select("ticker", "date", "n_headlines", "sent_mean", "sent_ewma3", "sent_surprise", "ret_1d", "fwd_ret_1d", "adj_close").orderBy(F.desc("date"), "ticker").limit(_limit(limit))


def newest_predictions(predictions: DataFrame, model: str | None = None, limit: int = 200) -> DataFrame:
    rows = predictions.where(F.col("model") == model) if model else predictions
    return rows.orderBy(F.desc("date"), "ticker", "model").limit(_limit(limit))


def metrics(store: Store) -> dict:
    """What the last training stored: champion, best on all features, and a row per model."""
    held = store.get_json("metrics")
    if held is None:
        raise NotReady("no metrics")
    return held


def monitor_now(predictions: DataFrame, features: DataFrame, window: int = SETTINGS.monitor_window, test_start: str = SETTINGS.test_start) -> list[dict]:
    """The state of every model now. The caller stores the rows it wants to keep."""
    return [r.asDict() for r in MO.check_drift(predictions, features, window=window, test_start=test_start).orderBy("model").collect()]  # a row a model


def monitor_history(predictions: DataFrame, model: str | None = None, window: int = SETTINGS.monitor_window) -> DataFrame:
    """The rolling report of one model or of all, with dates as text."""
    out = MO.rolling_report(predictions.where(F.col("model") == model) if model else predictions, window)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd")).orderBy("model", "date")


def plain(value: object) -> object:
    """``value`` as JSON can say it: what is not a finite number is null, dates and the like are text."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def predict(bundle: tuple[str, list[str], object] | None, values: Mapping[str, float]) -> dict:
    """The served model's answer to one request."""
    if bundle is None:
        raise NotReady("no model")
    name, columns, model = bundle
    return {"model": name, **M.predict_one(model, values, columns=columns), "used_features": columns}


def figure(folder: str, name: str) -> str:
    """Path of a stored figure; only a bare name ending in .png is taken."""
    import os

    base = os.path.basename(name)
    path = os.path.join(folder, base)
    if base != name or not base.endswith(".png") or not os.path.exists(path):
        raise NotFound(name)
    return path


def dashboard(spark: SparkSession, headlines: DataFrame, features: DataFrame, metric_rows: list[dict], monitor_rows: list[dict]) -> str:
    """A page with the counts, the metrics and the monitor table."""
    from html import escape

    n = health(headlines, features).first()

    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        cols = list(rows[0])
        cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else escape(str(v))
        body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in cols) + "</tr>" for r in rows)
        return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in cols) + f"</tr>{body}</table>"

    return f"<!doctype html><title>Signals</title><p>{n['n_headlines']:,} headlines, {n['n_features']:,} feature rows</p><h2>Models</h2>{table(metric_rows)}<h2>Monitor</h2>{table(monitor_rows)}"
