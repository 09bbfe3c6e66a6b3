"""Queries and models do the whole job."""

import dataclasses
import datetime as dt
import inspect

import pytest
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.operators import models as M
from quillpanel.plans import figures, pipeline
from quillpanel.sources.writers import Store

from .test_panel import _day, _features


def test_coverage_has_every_month(spark):
    h = spark.createDataFrame([("a", dt.date(2020, 1, 5)), ("a", dt.date(2023, 5, 5)), ("b", dt.date(2020, 1, 7)), ("b", None)], "ticker string, trade_date date")
    assert figures.coverage_pivot(h).columns == ["ticker", "2020-01", "2023-05"]
    assert {tuple(r) for r in figures.coverage(h).collect()} == {("a", "2020-01", 1), ("a", "2023-05", 1), ("b", "2020-01", 1), ("b", "2023-05", 0)}
    assert figures.coverage(h).agg(F.sum("n")).first()[0] == h.where("trade_date is not null").count()


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).cache()


def test_ablation_and_training_use_the_tuned_strength(spark, features, tmp_path, monkeypatch):
    block = {"combined": ["sent_mean", "ret_1d"]}
    monkeypatch.setattr(M, "tuned_c", lambda train, columns, **_: 0.003)
    metrics = {r["model"]: r.asDict() for r in M.ablation(features, str(_day(30)), rounds=2, blocks=block).collect()}
    fixed = {r["model"]: r.asDict() for r in M.ablation(features, str(_day(30)), c=0.003, rounds=2, blocks=block).collect()}
    assert metrics["logreg__combined"] == fixed["logreg__combined"] and metrics["logreg__combined"]["C"] == 0.003
    assert metrics["hgb__combined"]["C"] is None


def test_tuning_is_the_mean_over_the_folds(features):
    columns = ["sent_mean", "ret_1d"]
    got = {r["c"]: r["auc"] for r in M.tuning(features, columns, grid=(0.003, 1.0), n=2).collect()}
    for c in (0.003, 1.0):
        each = [M.auc(test.withColumn("p", M.logistic(fit, columns, c=c).probability()), "target_next_up", "p").first()[0] for fit, test in M.folds(features, 2)]
        assert got[c] == pytest.approx(sum(each) / 2)


def test_training_refits_with_the_strength_of_the_metrics(spark, features, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    pipeline.init(store)
    store.write("features", features)
    settings = dataclasses.replace(SETTINGS, test_start=str(_day(30)))
    monkeypatch.setattr(M, "ablation", lambda *_, **__: spark.createDataFrame([("logreg__combined", 0.6, 0.003)], "model string, balanced_accuracy double, C double"))
    pipeline.train(store, settings)
    fit, _ = M.split(features, settings.test_start)
    kept = M.load_bundle(spark, f"{store.root}/models/logreg__combined")[2]
    want = M.logistic(fit, M.BLOCKS["combined"], c=0.003)
    assert dict(kept.coefficients) == pytest.approx(dict(want.coefficients), abs=1e-9)
    assert store.read("predictions").count() == features.where(F.col("date") >= F.lit(str(_day(30))).cast("date")).count()


def test_boosted_keeps_the_best_trees(spark, features, tmp_path):
    noise = features.withColumn("target_next_up", (F.hash("ticker", "date") % 2 == 0).cast("int"))
    model, best = M.boosted(noise, ["sent_mean", "volume_z"], rounds=15, depth=5, step=0.5)
    trees = model.stages[-1]
    assert best < 15 and trees.getNumTrees == len(trees.treeWeights) == best
    columns = ["sent_mean", "volume_z"]
    rows = M.VectorAssembler(inputCols=columns, outputCol="_x").transform(noise).withColumn("_y", F.col("target_next_up").cast("double"))
    whole = M.GBTClassifier(featuresCol="_x", labelCol="_y", maxDepth=3, maxIter=6, seed=1).fit(rows)
    short = M.GBTClassifier(featuresCol="_x", labelCol="_y", maxDepth=3, maxIter=4, seed=1).fit(rows)
    score = lambda m: {(r["ticker"], r["date"]): r["probability"][1] for r in m.transform(rows).collect()}
    assert score(M.first_trees(whole, 4)) == pytest.approx(score(short))
    M.save_bundle(spark, str(tmp_path / "t"), "t", columns, model)
    assert M.load_bundle(spark, str(tmp_path / "t"))[2].stages[-1].getNumTrees == best


def test_queries_boost_the_default_rounds(spark, monkeypatch):
    from quillpanel.operators import experiments as EX
    from quillpanel.plans import panel_queries as PQ

    asked = []

    def noted(name, rounds_of):
        real = inspect.signature(rounds_of).parameters["rounds"].default

        def stand_in(*args, **kwargs):
            asked.append((name, kwargs.get("rounds", real)))
            raise StopIteration

        return stand_in

    for module, name in ((M, "boosted"), (M, "ablation"), (M, "cross_sectional_run"), (EX, "leakage_comparison"), (EX, "same_day_leak")):
        monkeypatch.setattr(module, name, noted(name, getattr(module, name)))
    monkeypatch.setattr(M, "split", lambda df, cut: (df, df))
    for query in ("m4_boosted_trees", "m11_ablation", "d15_cross_sectional_run", "d12_leakage_comparison", "d13_same_day_leak"):
        with pytest.raises(StopIteration):
            PQ.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert asked == [("boosted", 200), ("ablation", 200), ("cross_sectional_run", 200), ("leakage_comparison", 200), ("same_day_leak", 200)]


def test_wide_and_csv_queries_take_every_ticker(spark):
    from quillpanel.plans import panel_queries as PQ
    from quillpanel.plans import reference_queries as RQ
    from quillpanel.plans.base import Base

    sf = "/root/testdata/sf0.001"
    want = {r[0] for r in Base(spark, sf).px.where("close is not null").select("ticker").distinct().collect()}
    for query in (PQ.QUERIES["d4_wide_to_long"], RQ.QUERIES["a6_csv_prices"]):
        assert {r[0] for r in query(spark, sf).where("close is not null").select("ticker").distinct().collect()} == want


def test_pipeline_query_runs_every_stage(spark, monkeypatch):
    from quillpanel.plans import panel_queries as PQ

    real = M.boosted
    monkeypatch.setattr(M, "boosted", lambda train, columns, target="target_next_up", rounds=200, **more: real(train, columns, target, 2, **more))
    monkeypatch.setattr(M, "tuned_c", lambda *_, **__: 0.1)
    n = {r["table_name"]: r["n"] for r in PQ.QUERIES["r1_pipeline"](spark, "/root/testdata/sf0.01").collect()}
    assert {"prices", "headlines", "sentiment", "features", "analyse_lead_lag", "analyse_peak", "analyse_ic", "analyse_buckets"} < set(n)
    assert n["train_metrics"] == 9 and n["xs_models"] == 7 and n["predictions"] > 0 and 1 <= n["monitor_log"] <= 2
