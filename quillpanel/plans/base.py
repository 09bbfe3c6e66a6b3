"""The stored tables without their repeats, for queries that expect clean keys, and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.functions.keys import clean_ticker, clean_uid
from quillpanel.runtime import prepare, read
from quillpanel.sources.schema import FEATURES

MODEL = "finlex-base"


def r6(c: Column | str) -> Column:
    """Rounded to six places, the same way in SQL (see ``R``): a hair is added so that no value lies on an edge."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6) + 0.0


def R(e: str) -> str:  # noqa: N802
    return f"(round(({e}) + 1e-10, 6) + 0.0)"


class Base:
    """One row per key of each table; where repeats differ, the least or greatest value of each column counts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def raw(self, table: str) -> DataFrame:
        return read(self.spark, self.dir, table)

    @cached_property
    def px(self) -> DataFrame:
        return self.raw("prices").groupBy(clean_ticker("ticker").alias("ticker"), "date").agg(*[F.max(c).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")])

    @cached_property
    def hl(self) -> DataFrame:
        h = self.raw("headlines").withColumn("ticker", clean_ticker("ticker"))
        return h.groupBy(clean_uid("headline_uid").alias("headline_uid")).agg(*[F.min(c).alias(c) for c in ("ticker", "published_at", "trade_date", "title")], F.min(F.coalesce("publisher", F.lit(""))).alias("publisher"), F.min(F.coalesce("url", F.lit(""))).alias("url"))

    @cached_property
    def sen(self) -> DataFrame:
        return self.raw("sentiment").groupBy(clean_uid("headline_uid").alias("headline_uid"), "model").agg(*[F.max(c).alias(c) for c in ("p_neg", "p_neu", "p_pos", "score", "label")]).where("score is not null")

    @cached_property
    def ft(self) -> DataFrame:
        return self.raw("features").groupBy("ticker", "date").agg(*[F.max(c).alias(c) for c in (*FEATURES, "fwd_ret_1d", "target_next_up")])

    @cached_property
    def pr(self) -> DataFrame:
        p = self.raw("predictions").where("not isnan(prob_up)")
        return p.groupBy("model", clean_ticker("ticker").alias("ticker"), "date").agg(*[F.max(c).alias(c) for c in ("prob_up", "pred_up", "realized_ret", "realized_up")])


BASE = f"""
px AS (SELECT upper(trim(ticker)) AS ticker, date, {", ".join(f"max({c}) AS {c}" for c in ("open", "high", "low", "close", "adj_close", "volume"))} FROM prices GROUP BY 1, 2),
hl AS (SELECT lower(trim(headline_uid)) AS headline_uid, min(upper(trim(ticker))) AS ticker, min(published_at) AS published_at, min(trade_date) AS trade_date, min(title) AS title, min(coalesce(publisher, '')) AS publisher, min(coalesce(url, '')) AS url FROM headlines GROUP BY 1),
sen AS (SELECT * FROM (SELECT lower(trim(headline_uid)) AS headline_uid, model, {", ".join(f"max({c}) AS {c}" for c in ("p_neg", "p_neu", "p_pos", "score", "label"))} FROM sentiment GROUP BY 1, 2) WHERE score IS NOT NULL),
ft AS (SELECT ticker, date, {", ".join(f"max({c}) AS {c}" for c in (*FEATURES, "fwd_ret_1d", "target_next_up"))} FROM features GROUP BY 1, 2),
pr AS (SELECT model, upper(trim(ticker)) AS ticker, date, {", ".join(f"max({c}) AS {c}" for c in ("prob_up", "pred_up", "realized_ret", "realized_up"))} FROM predictions WHERE CAST(prob_up AS VARCHAR) <> 'nan' GROUP BY 1, 2, 3),
cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT CAST(date AS DATE) AS session FROM px))"""
