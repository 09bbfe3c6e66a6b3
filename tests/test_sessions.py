"""Attribution to sessions: what is silently wrong when it breaks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import sessions as S

DAYS = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(19)) if d.weekday() < 5 and d != dt.date(2024, 1, 10)]


@pytest.fixture(scope="module")
def calendar(spark):
    prices = spark.createDataFrame([(t, d) for d in DAYS for t in ("A", "B")], "ticker string, date date")
    return S.calendar(prices).cache()


def _at(spark, calendar, moment, lag=0):
    df = spark.createDataFrame([(moment,)], "published_at timestamp_ntz")
    return S.attribute(df, calendar, lag=lag).first()["trade_date"]


@pytest.mark.parametrize("moment,lag,session", [
    ("2024-01-08 14:00", 0, "2024-01-08"),  # before the close
    ("2024-01-08 22:00", 0, "2024-01-09"),  # after it
    ("2024-01-08 21:00", 0, "2024-01-09"),  # 16:00 itself is after
    ("2024-01-08 20:59", 0, "2024-01-08"),
    ("2024-01-06 15:00", 0, "2024-01-08"),  # weekend
    ("2024-01-09 22:00", 0, "2024-01-11"),  # holiday
    ("2024-01-08 14:00", 1, "2024-01-09"),
    ("2023-12-20 14:00", 0, "2024-01-01"),  # before the calendar
    ("2024-01-19 14:00", 1, None),  # past it
    ("2024-02-19 14:00", 0, None),
])
def test_sessions(spark, calendar, moment, lag, session):
    got = _at(spark, calendar, dt.datetime.fromisoformat(moment), lag)
    assert got == (dt.date.fromisoformat(session) if session else None)


def test_daylight_saving(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 8, 21),), (dt.datetime(2024, 7, 8, 20),)], "at timestamp_ntz")
    rows = df.select(S.exchange_time(F.col("at")).alias("x"), S.after_cutoff(S.exchange_time(F.col("at"))).alias("after")).collect()
    assert all(r["x"].hour == 16 and r["after"] for r in rows)


def test_never_a_past_session(spark, calendar):
    moments = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k),) for k in range(58)]
    out = S.attribute(spark.createDataFrame(moments, "published_at timestamp_ntz"), calendar, lag=1)
    rows = out.withColumn("local", F.to_date(S.exchange_time(F.col("published_at")))).where("trade_date is not null").collect()
    assert rows and all(r["trade_date"] >= r["local"] for r in rows)


def test_no_lookahead_by_request(spark, calendar):
    with pytest.raises(ValueError):
        _at(spark, calendar, dt.datetime(2024, 1, 8), -1)


def test_index_edges(spark, calendar):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (4, 5, 6, 7, 8, 10, 11)] + [(None,)], "d date")
    got = {r["d"]: r["i"] for r in S.with_session_index(df, F.col("d"), calendar, "i").collect()}
    n = {d: i for i, d in enumerate(DAYS)}
    assert got[dt.date(2024, 1, 6)] == n[dt.date(2024, 1, 8)] == got[dt.date(2024, 1, 7)]
    assert got[dt.date(2024, 1, 10)] == n[dt.date(2024, 1, 11)] and got[None] is None


def test_empty_calendar(spark):
    empty = S.calendar(spark.createDataFrame([], "ticker string, date date"))
    assert _at(spark, empty, dt.datetime(2024, 1, 8)) is None
