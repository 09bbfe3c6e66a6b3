"""The whole pipeline fits each model once, and what can share a pass or an exchange does."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.functions import stats
from quillpanel.operators import cross_section as XS
from quillpanel.operators import models as M
from quillpanel.plans import pipeline
from quillpanel.sources.writers import Store

from .test_boosting import jobs_of
from .test_panel import _day, _features


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).cache()


def test_training_stores_the_models_it_measured(spark, features, tmp_path, monkeypatch):
    grown, fitted, real = [], [], (M.boosted, M.logistic)
    monkeypatch.setattr(M, "boosted", lambda *a, **k: grown.append(1) or real[0](*a, **k))
    monkeypatch.setattr(M, "logistic", lambda *a, **k: fitted.append(1) or real[1](*a, **k))
    monkeypatch.setattr(M, "champion", lambda metrics, like="", **_: metrics.where(F.col("model") == ("logreg__combined" if like else "hgb__price_only")))
    store = Store(spark, str(tmp_path / "store"))
    pipeline.init(store)
    store.write("features", features)
    pipeline.train(store, dataclasses.replace(SETTINGS, test_start=str(_day(30))), rounds=2)
    assert len(grown) == 3 and not fitted
    assert {r["model"] for r in store.read("predictions").select("model").distinct().collect()} == {"hgb__price_only", "logreg__combined"}
    assert dict(M.load_bundle(spark, f"{store.root}/models/combined")[2].coefficients).keys() == set(M.BLOCKS["combined"])


def test_blocks_together_are_the_blocks_alone(features):
    blocks, used = list(M.BLOCKS.values()), [0.1, 0.003, 0.1]
    for got, columns, c in zip(M.logistic_blocks(features, blocks, used), blocks, used):
        want = M.logistic(features, columns, c=c)
        assert dict(got.coefficients) == pytest.approx(dict(want.coefficients), abs=1e-8) and got.intercept == pytest.approx(want.intercept, abs=1e-8)
    together = {(r["block"], r["c"]): r["auc"] for r in M.tunings(features, blocks, grid=(0.01, 1.0), n=2).collect()}
    for k, columns in enumerate(blocks):
        for r in M.tuning(features, columns, grid=(0.01, 1.0), n=2).collect():
            assert together[k, r["c"]] == pytest.approx(r["auc"], abs=1e-9)


def _scored(spark):
    random.seed(6)
    rows = [(m, dt.date(2023, 1, 2 + d), f"t{k}", round(random.gauss(0, 1), 1) if random.random() > 0.1 else None, random.randint(0, 1), random.gauss(0, 0.01)) for m in ("a", "b", "c") for d in range(12) for k in range(9)]
    rows += [("b", dt.date(2023, 2, 1), "t1", float("nan"), 1, 0.01)]
    return spark.createDataFrame(rows, "model string, date date, ticker string, score double, target_rel int, fwd_ret_1d double").cache()


def test_rankings_compared_at_once(spark):
    """A model without rows has what no rows give."""
    scored, cuts = _scored(spark), {"c": 0.5, "b": None, "a": 0.0, "none": None}
    rows, jobs = jobs_of(spark, lambda: XS.compared(scored, cuts, 5, 3.0).collect())
    assert [r["model"] for r in rows] == list(cuts) and jobs < 45
    for r, (m, cut) in zip(rows, cuts.items()):
        own = scored.where(F.col("model") == m)
        one = XS.accuracy(own, "score", cut=cut).first().asDict() | XS.backtest_stats(XS.long_short(own, "score", cost_bps=3.0), 3.0).first().asDict()
        ic = XS.ic_summary(XS.daily_ic(own, "score", least=5)).withColumnRenamed("n_days", "ic_days").first().asDict()
        for name, want in {**one, **ic}.items():
            assert r[name] == (want if want is None else pytest.approx(want, abs=1e-12)), (m, name)


@pytest.mark.parametrize("n", [3, 10_000])
def test_medians_of_groups(spark, n):
    x = {"a": [3.0, 1.0, 2.0], "b": [5.0, 5.0, 1.0, 9.0], "c": [7.0], "d": [1.0, 2.0, 2.5, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in x.items() for v in vs], "g string, x double").cache()
    assert {r["g"]: r["median"] for r in stats.group_medians(df, "g", "x", n).collect()} == {"a": 2.0, "b": 5.0, "c": 7.0, "d": 2.25}
    sums = {r["g"]: (r["r"], r["p"], r["n"]) for r in stats.rank_sums(df, "g", "x", F.col("x") >= 5, n).collect()}
    assert sums == {"a": (None, 0, 3), "b": (9.0, 3, 4), "c": (1.0, 1, 1), "d": (None, 0, 4)}
