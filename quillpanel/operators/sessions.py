"""News attributed to trading sessions without lookahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS


def calendar(prices: DataFrame) -> DataFrame:
    """``(session, idx)``: the distinct dates of all tickers in order, from 0. As many rows as there are trading days."""
    days = prices.select(F.col("date").cast("date").alias("session")).where("session is not null").distinct()
    return days.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")) - 1)


def day_lookup(sessions: DataFrame) -> DataFrame:
    """``(civil_day, idx)``: for each day between the first and the last session the first session at or after it."""
    before = F.lag("session").over(Window.partitionBy(F.lit(0)).orderBy("session"))
    spans = sessions.withColumn("since", F.coalesce(F.date_add(before, 1), F.col("session")))
    return spans.select(F.explode(F.sequence("since", "session")).alias("civil_day"), "idx")


def exchange_time(published_at: Column, tz: str = SETTINGS.market_tz) -> Column:
    """Wall-clock time at the exchange of a naive UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), published_at.cast("timestamp_ntz"))


def after_cutoff(local: Column, cutoff: str = SETTINGS.session_cutoff) -> Column:
    hour, minute = (int(x) for x in cutoff.split(":"))
    return F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute


def candidate_day(published_at: Column, tz: str = SETTINGS.market_tz, cutoff: str = SETTINGS.session_cutoff) -> Column:
    """The first day whose close the news could inform: from the cutoff on, the next one."""
    local = exchange_time(published_at, tz)
    return F.date_add(F.to_date(local), after_cutoff(local, cutoff).cast("int"))


def with_session_index(df: DataFrame, day: Column, sessions: DataFrame, out: str = "idx") -> DataFrame:
    """``df`` with the index of the first session at or after ``day``: 0 before the first session, their number after the last.

    An equality join with a table of civil days, which grows with the calendar
    and not with the data: its broadcast is bounded.
    """
    lookup = F.broadcast(day_lookup(sessions).withColumnsRenamed({"civil_day": "_day", "idx": "_idx"}))
    ends = sessions.agg(F.struct(F.min("session").alias("first"), F.max("session").alias("last"), F.count("*").alias("n"))).scalar()
    found = df.withColumn("_for", day).withColumn("_ends", ends).join(lookup, F.col("_for") == F.col("_day"), "left")
    idx = F.when(F.col("_for") < F.col("_ends.first"), 0).when(F.col("_for") > F.col("_ends.last"), F.col("_ends.n")).otherwise(F.col("_idx"))
    return found.withColumn(out, idx.cast("int")).drop("_day", "_idx", "_for", "_ends")


def attribute(df: DataFrame, sessions: DataFrame, published_at: str = "published_at", lag: int = SETTINGS.extra_lag_sessions, out: str = "trade_date", tz: str = SETTINGS.market_tz, cutoff: str = SETTINGS.session_cutoff) -> DataFrame:
    """``df`` with the session its news may be used in: local time, cutoff, first session at or after, ``lag`` sessions more; null past the calendar."""
    if lag < 0:
        raise ValueError("a negative lag would look ahead")
    placed = with_session_index(df, candidate_day(F.col(published_at), tz, cutoff), sessions, "_at")
    to = F.broadcast(sessions.select(F.col("idx").alias("_to"), F.col("session").alias("_session")))  # one row a trading day
    return placed.join(to, F.col("_at") + lag == F.col("_to"), "left").withColumn(out, F.col("_session")).drop("_at", "_to", "_session")
