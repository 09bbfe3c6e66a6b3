"""Readers and writers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillpanel.functions import text
from quillpanel.operators import headlines as HL
from quillpanel.plans import pipeline
from quillpanel.sources import readers, schema, writers

KEY = ["ticker", "date"]


def _px(spark, values, cols="ticker string, date date, adj_close double"):
    return spark.createDataFrame([("AAA", dt.date(2024, 1, 1) + dt.timedelta(k), float(v)) for k, v in enumerate(values)], cols)


def test_upsert_is_idempotent_and_partial(spark, tmp_path):
    store = writers.Store(spark, str(tmp_path))
    store.create("prices")
    for values in ([1, 2, 3], [1, 2, 3], [9, 9, 9]):
        store.upsert("prices", _px(spark, values), KEY)
    assert sorted(r["adj_close"] for r in store.read("prices").collect()) == [9, 9, 9]
    close = _px(spark, [5, 5, 5]).withColumnRenamed("adj_close", "close")
    rows = store.upsert("prices", close, KEY).collect()
    assert [(r["close"], r["adj_close"]) for r in rows] == [(5, 9)] * 3


def test_upsert_takes_the_last_of_repeats_and_turns_nan_into_null(spark):
    target = _px(spark, [1.0])
    rows = spark.createDataFrame([("AAA", dt.date(2024, 1, 1), 5.0, 2), ("AAA", dt.date(2024, 1, 1), float("nan"), 3)], "ticker string, date date, adj_close double, n int")
    assert writers.upserted(target, rows, KEY, F.col("n")).first()["adj_close"] is None
    assert writers.upserted(target, rows.where("n = 2"), KEY).first()["adj_close"] == 5.0
    only_keys = rows.select(*KEY)
    assert writers.upserted(target, only_keys, KEY).first()["adj_close"] == 1.0
    assert writers.upserted(target, rows.where("false"), KEY).count() == 1


def test_replace_drops_keys_without_new_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert {tuple(r) for r in writers.replaced(old, new, "k", ["a", "b"]).collect()} == {("a", 9), (None, 3)}


def test_backfill_fills_only_open_rows(spark):
    d = dt.date(2024, 1, 1)
    p = spark.createDataFrame([("m", "a", d, 0.5, 1, 0.7, None), ("m", "b", d, 0.5, 1, 0.7, 1), ("m", "c", d, 0.5, 1, 0.7, None)], "model string, ticker string, date date, prob_up double, pred_up int, realized_ret double, realized_up int")
    f = spark.createDataFrame([("a", d, 0.1, 1), ("b", d, 0.2, 0)], "ticker string, date date, fwd_ret_1d double, target_next_up int")
    got = {r["ticker"]: (r["realized_ret"], r["realized_up"]) for r in writers.backfilled(p, f).collect()}
    assert got == {"a": (0.1, 1), "b": (0.7, 1), "c": (None, None)}


def test_log_ids_go_on(spark, tmp_path):
    store = writers.Store(spark, str(tmp_path))
    fields = spark.createDataFrame([], "id long, model string").schema
    store.create("log", fields=fields)
    rows = spark.createDataFrame([("x",), ("y",)], "model string")
    for _ in range(2):
        store.append("log", writers.numbered(rows, store.read("log"), ["model"]).select("id", "model"))
    assert sorted(r["id"] for r in store.read("log").collect()) == [1, 2, 3, 4]
    assert store.create("log", drop=True, fields=fields).count() == 0


def test_violations(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 1), 2.0)], "ticker string, date date, close double")
    assert {r["rule"]: r["n"] for r in schema.violations(df, "prices").collect()} == {"date": 1, "primary key": 1}


def test_csv_skips_missing_and_fails_without_any(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-02-02,1,2,0.5,2.5,100\n")
    got = readers.csv_prices(spark, {"A": str(tmp_path / "A.csv"), "B": str(tmp_path / "B.csv")}, "2024-01-01", "2024-01-31").collect()
    assert [(r["ticker"], r["close"], r["adj_close"]) for r in got] == [("A", 1.5, 1.5)]
    with pytest.raises(FileNotFoundError):
        readers.csv_prices(spark, {"B": str(tmp_path / "B.csv")}, "2024-01-01", "2024-01-31")


def test_wide_to_long_of_one_ticker(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None), (dt.date(2024, 1, 2), None, None)], "date date, close double, volume double")
    assert [tuple(r) for r in readers.wide_to_long(wide, ["close", "volume"]).collect()] == [("", dt.date(2024, 1, 1), 1.0, None)]


def test_pick_takes_only_known_columns(spark):
    with pytest.raises(ValueError):
        readers.pick(spark.range(1), ["id"], "id; drop table x")


def test_uid(spark):
    df = spark.createDataFrame([("AAPL", dt.datetime(2024, 1, 2), " Apple beats estimates "), ("AAPL", dt.datetime(2024, 1, 2), "Apple beats estimates"), ("AAPL", dt.datetime(2024, 1, 2), "Other"), ("AAPL", dt.datetime(2024, 1, 2, 0, 0, 0, 5), "Other")], "t string, at timestamp_ntz, title string")
    uid = [r["u"] for r in df.select(text.record_uid(F.col("t"), F.col("at"), F.col("title")).alias("u")).collect()]
    import hashlib

    assert uid[0] == uid[1] == hashlib.sha1(b"AAPL|2024-01-02T00:00:00|Apple beats estimates").hexdigest()
    assert uid[3] == hashlib.sha1(b"AAPL|2024-01-02T00:00:00.000005|Other").hexdigest() != uid[2]


def test_clean(spark):
    rows = [
        ("A", "2024-01-02 10:00:00 UTC", "A  title\twith  blanks", None, None), ("A", "2024-01-02 10:00:00", "A title with blanks", "P" * 200, "u"),
        ("A", "garbage", "A title with blanks", "p", "u"), ("A", "2024-01-02", "14 characters.", "p", "u"), ("A", "2024-01-02", "15 characters..", "p", "u"), ("A", "2024-01-02", None, "p", "u"),
    ]
    got = sorted(tuple(r) for r in HL.clean(spark.createDataFrame(rows, "ticker string, published_at string, title string, publisher string, url string")).select("title", "publisher", "url").collect())
    assert got == [("15 characters..", "p", "u"), ("A title with blanks", "", "")]


def test_pipeline_over_a_store(spark, tmp_path):
    store = writers.Store(spark, str(tmp_path))
    pipeline.init(store)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(60)]
    prices = spark.createDataFrame([(t, d, 1.0, 1.0, 1.0, 1.0, 100.0 + (k * 7) % 11, 10.0 + k % 5) for t in ("A", "B") for k, d in enumerate(days)], "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double")
    pipeline.ingest_prices(store, prices)
    raw = spark.createDataFrame([(t, dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=k), f"Headline number {k} beats forecasts", "p", "u") for t in ("A", "B") for k in range(58)], "ticker string, published_at timestamp_ntz, title string, publisher string, url string")
    for _ in range(2):
        pipeline.ingest_headlines(store, raw, ["A", "B"])
        pipeline.score(store)
    assert store.read("headlines").count() == store.read("sentiment").count() == 116
    f = pipeline.build_features(store)
    assert 0 < f.count() <= 116
    wrong = f.join(prices.select("ticker", "date", "adj_close"), ["ticker", "date"]).where("(fwd_ret_1d > 0) <> (target_next_up = 1)").count()
    late = store.read("headlines").where("trade_date < to_date(published_at)").count()
    assert wrong == late == 0
