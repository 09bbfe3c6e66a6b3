"""Raw headlines to the stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions.text import one_line, parse_utc, record_uid
from quillpanel.operators import sessions as S


def first_of(df: DataFrame, key: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order`` and then by the other columns: a total order, so the same row every time.

    An aggregate with map-side combining; nulls sort first.
    """
    names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(key)]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(key, names) if not isinstance(k, str)])
    rest = [c for c in df.columns if c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_row")
    return keyed.groupBy(*names).agg(least).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def clean(raw: DataFrame, least_length: int = 15) -> DataFrame:
    """Headlines with a time, one-line titles of a least length, each (ticker, time, title) once, publisher and url filled.

    Of repeated records the one with the least publisher and url stays. A
    ``published_at`` that is text is parsed; one that can't be is left out.
    """
    moment = parse_utc(F.col("published_at")) if raw.schema["published_at"].dataType.typeName() == "string" else F.col("published_at").cast("timestamp_ntz")
    rows = raw.select(
        "ticker", moment.alias("published_at"), one_line(F.col("title")).alias("title"),
        F.substring(F.coalesce("publisher", F.lit("")), 1, 128).alias("publisher"), F.coalesce("url", F.lit("")).alias("url"),
    ).where(F.col("published_at").isNotNull() & (F.length("title") >= least_length))
    return first_of(rows, ["ticker", "published_at", "title"], ["publisher", "url"])


def ingest(raw: DataFrame, prices: DataFrame, lag: int = SETTINGS.extra_lag_sessions, start: str = SETTINGS.start_date, end: str = SETTINGS.end_date) -> DataFrame:
    """Rows of ``headlines``: cleaned, attributed, within the dates, named by their content hash, each hash once."""
    placed = S.attribute(clean(raw), S.calendar(prices), lag=lag).where(F.col("trade_date").isNotNull() & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    named = placed.select(record_uid(F.col("ticker"), F.col("published_at"), F.col("title")).alias("headline_uid"), "ticker", "published_at", "trade_date", "title", "publisher", "url")
    return first_of(named, ["headline_uid"], ["ticker", "published_at", "title"])


def unscored(headlines: DataFrame, sentiment: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Headlines without a row of ``model``; with ``limit`` the first by uid, so that a stopped run goes on where it was."""
    left = headlines.join(sentiment.where(F.col("model") == model), "headline_uid", "left_anti")
    return left if limit is None else left.orderBy("headline_uid").limit(limit)
