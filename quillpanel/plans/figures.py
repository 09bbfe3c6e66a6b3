"""The data behind each figure; drawing is left to the reader's own tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions.windows import rolling_mean


def price_and_sentiment(prices: DataFrame, features: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """``(date, indexed, sent, smoothed)``: the price from 100 at the start, the day's sentiment on the price calendar, and its mean over 10 rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    px = prices.where((F.col("ticker") == ticker) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("adj_close").isNotNull())
    px = px.select("ticker", "date", (100 * F.try_divide("adj_close", F.first("adj_close").over(w))).alias("indexed"))
    joined = px.join(features.where(F.col("ticker") == ticker).select("date", F.col("sent_mean").alias("sent")), "date", "left")
    return joined.select("date", "indexed", "sent", rolling_mean(F.col("sent"), w, 10, 3).alias("smoothed"))


def gaps(series: DataFrame, longest: int = 10) -> DataFrame:
    """``(start, end, n_rows)``: runs of more than ``longest`` rows of ``series`` (one ticker's calendar) without sentiment."""
    every, same = Window.partitionBy(F.lit(0)).orderBy("date"), Window.partitionBy(F.col("sent").isNull()).orderBy("date")
    runs = series.select("date", F.col("sent").isNull().alias("none"), (F.row_number().over(every) - F.row_number().over(same)).alias("run"))
    return runs.where("none").groupBy("run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_rows")).where(F.col("n_rows") > longest).drop("run")


def coverage_pivot(headlines: DataFrame, months: list[str] | None = None) -> DataFrame:
    """A row per ticker, a column per month (``yyyy-MM``), 0 where there is no news; without ``months`` every month there is."""
    rows = headlines.select("ticker", F.date_format("trade_date", "yyyy-MM").alias("month"))
    if months is None:
        months = [r[0] for r in rows.where("month is not null").select("month").distinct().orderBy("month").collect()]  # bounded by the calendar
    return rows.groupBy("ticker").pivot("month", months).count().fillna(0)


def coverage(headlines: DataFrame) -> DataFrame:
    """``(ticker, month, n)``: the pivot over every month in long form, whose columns do not depend on the table."""
    wide = coverage_pivot(headlines)
    months = [c for c in wide.columns if c != "ticker"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(m).alias("n")) for m in months]).cast("array<struct<month:string,n:bigint>>"))
    return wide.select("ticker", each.alias("_m")).select("ticker", "_m.*")


def ranking(metrics: DataFrame) -> DataFrame:
    """Models by accuracy with the best baseline's beside them."""
    best = metrics.where(F.col("model").startswith("baseline")).agg(F.max("accuracy")).scalar()
    return metrics.withColumn("baseline_accuracy", best).select("model", "accuracy", "baseline_accuracy", F.col("model").startswith("baseline").alias("is_baseline")).orderBy("accuracy", "model")
