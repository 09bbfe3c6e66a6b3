"""Stored tables: schemas, primary keys, and checks that Parquet does not make itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTIMENT_FEATURES = ["n_headlines", "sent_mean", "sent_std", "sent_pos_frac", "sent_neg_frac", "sent_net", "sent_ewma3", "sent_surprise", "news_vol_z"]
PRICE_FEATURES = ["ret_1d", "ret_5d", "vol_5d", "ma_gap", "ma_cross", "volume_z"]
FEATURES = SENTIMENT_FEATURES + PRICE_FEATURES

_DDL = {
    "headlines": "headline_uid string NOT NULL, ticker string NOT NULL, published_at timestamp_ntz NOT NULL, trade_date date NOT NULL, title string NOT NULL, publisher string, url string",
    "sentiment": "headline_uid string NOT NULL, model string NOT NULL, p_neg double NOT NULL, p_neu double NOT NULL, p_pos double NOT NULL, score double NOT NULL, label string NOT NULL",
    "prices": "ticker string NOT NULL, date date NOT NULL, open double, high double, low double, close double, adj_close double, volume double",
    "features": "ticker string NOT NULL, date date NOT NULL, " + ", ".join(f"{c} double" for c in FEATURES) + ", fwd_ret_1d double, target_next_up int",
    "predictions": "model string NOT NULL, ticker string NOT NULL, date date NOT NULL, prob_up double NOT NULL, pred_up int NOT NULL, realized_ret double, realized_up int, created_at timestamp_ntz",
    "monitor_log": "id bigint NOT NULL, model string NOT NULL, asof_date date NOT NULL, window int NOT NULL, n_obs int NOT NULL, rolling_accuracy double, baseline_accuracy double, psi_sent_mean double, status string, note string, created_at timestamp_ntz",
}
KEYS = {
    "headlines": ["headline_uid"], "sentiment": ["headline_uid", "model"], "prices": ["ticker", "date"],
    "features": ["ticker", "date"], "predictions": ["model", "ticker", "date"], "monitor_log": ["id"],
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[table])


def violations(df: DataFrame, table: str) -> DataFrame:
    """``(rule, n)``: rows that break a NOT NULL or the primary key, by rule; none when the table is sound."""
    need = [f.name for f in schema(table).fields if not f.nullable]
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in need]).unpivot([], need, "rule", "n")
    repeats = df.groupBy(*KEYS[table]).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("primary key").alias("rule"), "n")
    return nulls.unionByName(repeats).where("n > 0")
