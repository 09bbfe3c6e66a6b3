"""Cross-section, models, monitor, service and streaming."""

import dataclasses
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.sources.writers import Store
from quillpanel.operators import cross_section as XS
from quillpanel.operators import experiments as EX
from quillpanel.operators import models as M
from quillpanel.operators import monitor as MO
from quillpanel.operators import scoring
from quillpanel.plans import cli, figures, service
from quillpanel.sources.schema import FEATURES

D0 = dt.date(2024, 1, 1)


def _day(k):
    return D0 + dt.timedelta(k)


def _features(spark, days=40, names=18, seed=1):
    random.seed(seed)
    rows = []
    for k in range(days):
        for n in range(names):
            x = [random.gauss(0, 1) for _ in FEATURES]
            f = 0.02 * x[1] + random.gauss(0, 0.02)
            rows.append((f"T{n:02d}", _day(k), *x, f, int(f > 0)))
    return spark.createDataFrame(rows, "ticker string, date date, " + ", ".join(f"{c} double" for c in FEATURES) + ", fwd_ret_1d double, target_next_up int")


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).cache()


def test_turnover_of_weights(spark):
    # Scores that give a/b, then b/c, then the same legs.
    rows = [(_day(0), "a", 3.0), (_day(0), "b", 1.0), (_day(0), "c", 2.0), (_day(1), "a", 2.0), (_day(1), "b", 3.0), (_day(1), "c", 1.0), (_day(2), "a", 2.0), (_day(2), "b", 3.0), (_day(2), "c", 1.0)]
    df = spark.createDataFrame([(*r, 0.01) for r in rows], "date date, ticker string, s double, fwd_ret_1d double")
    got = [r["turnover"] for r in XS.long_short(df, "s", n_side=1).orderBy("date").collect()]
    assert got == pytest.approx([1.0, 2.0, 0.0])  # b moves from -1 to 1, a to 0, c to -1


def test_skipped_days_do_not_reset_positions(spark):
    rows = [(_day(k), t, float(i), 0.0) for k in (0, 1, 2) for i, t in enumerate("abcd") if k != 1 or t == "a"]
    df = spark.createDataFrame(rows, "date date, ticker string, s double, fwd_ret_1d double")
    assert [r["turnover"] for r in XS.long_short(df, "s").orderBy("date").collect()] == [1.0, 0.0]


def test_half_labels(spark):
    rows = [(_day(0), t, v) for t, v in zip("abcde", (0.1, 0.2, 0.2, 0.3, 0.4))] + [(_day(1), t, 0.0) for t in "abcd"]
    got = XS.with_relative_target(spark.createDataFrame(rows, "date date, ticker string, fwd_ret_1d double")).collect()
    assert {(r["ticker"], r["target_rel"]) for r in got if r["date"] == _day(0)} == {("a", 0), ("b", 0), ("d", 1), ("e", 1)}
    assert {(r["ticker"], r["target_rel"]) for r in got if r["date"] == _day(1)} == {("a", 0), ("b", 0), ("c", 1), ("d", 1)}


def test_names_a_day(spark):
    rows = [(_day(n), f"t{k}", float(k), float(k)) for n in (14, 15, 16) for k in range(n)]
    df = spark.createDataFrame(rows, "date date, ticker string, s double, fwd_ret_1d double")
    assert XS.panel(df, 15).select("date").distinct().count() == 2
    assert sorted(r["ic"] for r in XS.daily_ic(df, "s", least=15).collect()) == pytest.approx([1.0, 1.0])


def test_constant_sides(spark):
    df = spark.createDataFrame([(_day(0), f"t{k}", 1.0, float(k)) for k in range(20)], "date date, ticker string, s double, fwd_ret_1d double")
    assert XS.daily_ic(df, "s").count() == 0
    assert {r["s"] for r in XS.zscored(df, ["s"]).collect()} == {0.0}
    empty = XS.ic_summary(XS.daily_ic(df, "s")).first()
    assert empty["n_days"] == 0 and empty["mean_ic"] is None and empty["ic_t"] is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (0, 0.35)], "y int, p double")
    assert M.auc(df, "y", "p").first()[0] == pytest.approx(0.75)
    assert M.auc(df.where("y = 1"), "y", "p").first()[0] is None


def test_split_needs_both_sides(features):
    with pytest.raises(ValueError):
        M.split(features, "1990-01-01")
    with pytest.raises(ValueError):
        M.split(features, "2090-01-01")


def test_logistic_is_the_optimum_and_predicts(features):
    train, test = M.split(features, str(_day(30)))
    cols = ["sent_mean", "ret_1d"]
    fit = M.logistic(train, cols, c=0.1)
    rows = fit.scaler.apply(train).select(*cols, "target_next_up").collect()
    n1 = sum(r["target_next_up"] for r in rows)
    weight = {1: len(rows) / (2 * n1), 0: len(rows) / (2 * (len(rows) - n1))}
    for c in cols:
        grad = fit.coefficients[c]
        for r in rows:
            z = fit.intercept + sum(fit.coefficients[k] * r[k] for k in cols)
            grad += 0.1 * weight[r["target_next_up"]] * (1 / (1 + math.exp(-z)) - r["target_next_up"]) * r[c]
        assert abs(grad) < 1e-2
    assert M.auc(test.withColumn("p", fit.probability()), "target_next_up", "p").first()[0] > 0.75
    answer = M.predict_one(fit, {"sent_mean": 2.0})
    assert answer["pred_up"] == 1 and answer["missing_features"] == ["ret_1d"]


def test_folds_go_forward(features):
    parts = M.folds(features.select("date", "ticker"))
    total = features.count()
    assert [t.count() for _, t in parts] == [total // 5] * 4
    for train, test in parts:
        assert train.agg(F.max("date")).first()[0] <= test.agg(F.min("date")).first()[0]


def test_tuned_strength(features):
    assert M.tuned_c(features, ["sent_mean"], grid=(0.1, 1.0), n=2) in (0.1, 1.0)


def test_ablation_and_champion(features):
    out = M.ablation(features, str(_day(30)), rounds=3, blocks={"combined": ["sent_mean", "ret_1d"]}).cache()
    assert {r["model"] for r in out.collect()} == {"logreg__combined", "hgb__combined", "baseline_always_up", "baseline_ma_cross", "baseline_sentiment_sign"}
    assert M.champion(out, like="combined").first()["model"].endswith("combined")


def test_blend():
    assert M.blended({"a": 3.0, "b": 4.0}, {"a": 0.0, "b": 2.0}, 0.5) == pytest.approx({"a": 0.3, "b": 0.9})
    assert M.blended({"a": 0.0}, {"a": 5.0}, 1.0) == {"a": 0.0}


def test_walk_forward_prefers_what_works(spark, features):
    shifted = XS.with_relative_target(features).withColumn("date", F.make_date(F.lit(2000) + (F.dayofyear("date") / 15).cast("int"), F.lit(1), (F.dayofyear("date") % 15 + 1).cast("int")))
    assert M.walk_forward_blend(shifted, ["sent_mean", "volume_z"], {"sent_mean": -1.0, "volume_z": 1.0}, least_history=100) > 0


def test_status(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 0.6, 0.5, 0.1), (2, day, 0.52, 0.55, 0.1), (3, day, 0.49, 0.3, None), (4, day, 0.6, 0.5, 0.3), (5, day, 0.49, 0.55, 0.3), (6, day, None, None, None), (7, None, None, None, None)]
    checks = spark.createDataFrame(rows, "k int, asof_date date, rolling_accuracy double, baseline_accuracy double, psi_sent_mean double")
    got = {r["k"]: r for r in MO.judged(checks, 0.5, 0.2).collect()}
    assert [got[k]["status"] for k in range(1, 8)] == ["OK", "WARN", "DRIFT", "DRIFT", "DRIFT", "OK", "NO_DATA"]
    assert got[5]["note"].count("is under") == 2 and got[5]["note"].endswith("PSI 0.300 is over 0.20") and got[1]["note"] == got[6]["note"]


def test_monitor_without_outcomes(spark, features):
    p = features.select(F.lit("m").alias("model"), "ticker", "date", F.lit(0.6).alias("prob_up"), F.lit(1).alias("pred_up"), F.lit(None).cast("double").alias("realized_ret"), F.lit(None).cast("int").alias("realized_up"))
    (row,) = MO.check_drift(p, features).collect()
    assert row["status"] == "NO_DATA" and row["n_obs"] == 0
    assert MO.check_drift(p.limit(0), features).collect() == []


def test_monitor(spark, features):
    p = features.select(F.lit("m").alias("model"), "ticker", "date", F.lit(0.6).alias("prob_up"), F.lit(1).alias("pred_up"), F.col("fwd_ret_1d").alias("realized_ret"), F.col("target_next_up").alias("realized_up"))
    other = p.withColumns({"model": F.lit("w"), "realized_up": 1 - F.col("realized_up")})
    got = {r["model"]: r for r in MO.check_drift(p.unionByName(other), features, window=20, test_start=str(_day(20))).collect()}
    row = got["m"]
    assert got["w"]["psi_sent_mean"] == row["psi_sent_mean"] and got["w"]["rolling_accuracy"] == pytest.approx(1 - row["rolling_accuracy"])
    assert row["n_obs"] == 20 * 18 and row["asof_date"] == _day(39) and row["rolling_accuracy"] == pytest.approx(row["baseline_accuracy"]) and row["psi_sent_mean"] < 0.2
    first = MO.rolling_report(p, 20).orderBy("date").collect()
    assert [r["rolling_accuracy"] is None for r in first[:6]] == [True] * 4 + [False] * 2


def test_same_day_leak_is_visible(spark, features):
    leaky = features.withColumn("ret_1d", F.col("sent_mean") * 0.01)
    rows = {r["label"]: r["accuracy"] for r in EX.same_day_leak(leaky, str(_day(30)), rounds=5).collect()}
    assert rows["same_day"] > 0.95 > rows["next_session"]


def test_service(spark, features, tmp_path):
    px = features.select("ticker", "date", F.lit(1.0).alias("adj_close"))
    rows = service.signal(features, px, "t03", 5).collect()
    assert [r["date"] for r in rows] == [_day(39 - k) for k in range(5)]
    for bad in (0, 5001):
        with pytest.raises(ValueError):
            service.signal(features, px, limit=bad)
    with pytest.raises(service.NotReady):
        service.metrics(Store(spark, str(tmp_path)))
    with pytest.raises(service.NotReady):
        service.features_schema(None, [])
    (tmp_path / "a.png").write_text("x")
    assert service.figure(str(tmp_path), "a.png").endswith("a.png")
    for bad in ("../a.png", "a.txt", "b.png"):
        with pytest.raises(service.NotFound):
            service.figure(str(tmp_path), bad)
    assert "&lt;m&gt;" in service.dashboard(spark, features, features, [{"model": "<m>", "accuracy": 0.5}], [])


def test_figures(spark):
    px = spark.createDataFrame([("a", _day(k), 50.0 + k) for k in range(20)], "ticker string, date date, adj_close double")
    ft = spark.createDataFrame([("a", _day(k), 0.1) for k in (0, 15)], "ticker string, date date, sent_mean double")
    series = figures.price_and_sentiment(px, ft, "a", str(D0), str(_day(30)))
    assert series.orderBy("date").first()["indexed"] == 100.0
    assert [(r["start"], r["end"], r["n_rows"]) for r in figures.gaps(series).collect()] == [(_day(1), _day(14), 14)]


def test_scorer(spark):
    df = spark.createDataFrame([("1", "Profit jumps, strong gains"), ("2", "Shares fall on weak sales, fraud probe"), ("3", None), ("4", "")], "headline_uid string, title string")
    got = {r["headline_uid"]: r["label"] for r in scoring.score(df, "m").collect()}
    assert got == {"1": "pos", "2": "neg", "3": "neu", "4": "neu"}


def test_stream_scores_arrivals_once(spark, tmp_path):
    from quillpanel.plans import pipeline
    from quillpanel.sources.writers import Store
    from quillpanel.streaming.ingest import stream_headlines

    store = Store(spark, str(tmp_path / "store"))
    pipeline.init(store)
    pipeline.ingest_prices(store, spark.createDataFrame([("A", _day(k), 1.0, 1.0) for k in range(30)], "ticker string, date date, adj_close double, volume double"))
    source = str(tmp_path / "in")
    for part in range(2):
        rows = [("A", dt.datetime(2024, 1, 2 + part, 12), f"A headline about profit {part}", "p", "u"), ("A", dt.datetime(2024, 1, 2, 12), "A headline that comes twice", "p", "u")]
        spark.createDataFrame(rows, "ticker string, published_at timestamp_ntz, title string, publisher string, url string").coalesce(1).write.mode("append").parquet(source)
        stream_headlines(spark, source, store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read("headlines").count() == store.read("sentiment").count() == 3


def test_cli():
    a = cli.parser().parse_args(["score", "--store", "x", "--limit", "5"])
    assert a.stage == "score" and a.limit == 5
    assert cli.ORDER.index("ingest") < cli.ORDER.index("features") < cli.ORDER.index("train")


def test_bundles_come_back(spark, features, tmp_path):
    train, test = M.split(features, str(_day(30)))
    linear = M.logistic(train, ["sent_mean", "ret_1d"])
    M.save_bundle(spark, str(tmp_path / "a"), "l", ["sent_mean", "ret_1d"], linear)
    assert M.load_bundle(spark, str(tmp_path / "a")) == ("l", ["sent_mean", "ret_1d"], linear)
    trees, rounds = M.boosted(train, ["sent_mean"], rounds=3)
    assert 1 <= rounds <= 3
    M.save_bundle(spark, str(tmp_path / "b"), "t", ["sent_mean"], trees)
    again = M.load_bundle(spark, str(tmp_path / "b"))[2]
    key = lambda m: sorted((r["ticker"], r["date"], r["prob_up"]) for r in M.boosted_probability(m, test).collect())
    assert key(again) == key(trees)


def test_what_json_cannot_say():
    assert service.plain({"a": [float("nan"), 1.5, None, True], "b": dt.date(2024, 1, 2), "c": float("-inf")}) == {"a": [None, 1.5, None, True], "b": "2024-01-02", "c": None}


def test_http(spark, features, tmp_path, monkeypatch):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from quillpanel.plans import pipeline
    from quillpanel.sources.writers import Store

    store = Store(spark, str(tmp_path))
    pipeline.init(store)
    http = cli.server(store, "127.0.0.1", 0, str(_day(30)), str(tmp_path / "drawn"))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_address[1]}"

    def ask(path, body=None):
        try:
            return 200, json.loads(urlopen(Request(at + path, json.dumps(body).encode() if body is not None else None)).read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health") == (200, {"status": "ok", "model_loaded": False, "model_name": None, "tickers": [], "n_headlines": 0, "n_features": 0})
        assert ask("/signal")[0] == 404 and ask("/metrics")[0] == 503 and ask("/predict", {"features": {}})[0] == 503 and ask("/features/schema")[0] == 503 and ask("/nothing")[0] == 404
        store.write("features", features)
        store.write("prices", features.select("ticker", "date", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")]))
        assert len(ask("/signal?ticker=t01&limit=3")[1]) == 3 and ask("/signal?limit=9999")[0] == 422
        assert ask("/predictions") == (200, []) and ask("/monitor") == (200, [])
        monkeypatch.setattr(M, "tuned_c", lambda *_, **__: 0.1)  # tuned elsewhere
        pipeline.train(store, dataclasses.replace(SETTINGS, test_start=str(_day(30))), rounds=2)
        metrics = ask("/metrics")[1]
        assert metrics["combined"].endswith("__combined") and len(metrics["results"]) == 9
        health = ask("/health")[1]
        assert health["model_loaded"] and health["model_name"] == metrics["combined"] and health["tickers"][0] == "T00"
        code, answer = ask("/predict", {"features": {"sent_mean": 3.0}})
        assert code == 200 and answer["model"] == metrics["combined"] and answer["pred_up"] == 1 and len(answer["missing_features"]) == 14
        assert ask("/features/schema")[1] == {"model": metrics["combined"], "features": FEATURES}
        # Outcomes are filled in; accuracies of the first days are null, not NaN.
        found = ask("/monitor")[1]
        assert {r["model"] for r in found} == {metrics["champion"], metrics["combined"]}
        one = ask(f"/monitor?model={metrics['combined']}")[1]
        assert [r["model"] for r in one] == [metrics["combined"]] and one[0]["n_obs"] > 0
        history = ask("/monitor/history?window=20")[1]
        assert {r["model"] for r in history} == {r["model"] for r in found} and history[0]["rolling_accuracy"] is None and history[-1]["rolling_accuracy"] is not None
        assert {r["model"] for r in ask(f"/monitor/history?model={metrics['combined']}")[1]} == {metrics["combined"]}
        (tmp_path / "drawn").mkdir()
        (tmp_path / "drawn" / "a.png").write_bytes(b"png")
        assert urlopen(at + "/figures/a.png").read() == b"png" and ask("/figures/b.png")[0] == 404 and ask("/figures/..%2Fmetrics.json")[0] == 404
        assert b"Models" in urlopen(at + "/").read()
    finally:
        http.shutdown()
