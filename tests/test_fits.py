"""How the fits of a comparison share the machine and the rows."""

import threading

import pytest
from pyspark.sql import functions as F

from quillpanel.operators import experiments as EX
from quillpanel.operators import models as M

from .test_panel import _day, _features


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark).cache()


def test_forests_grow_one_after_the_other(features, monkeypatch):
    busy, seen, real = threading.Lock(), [], M.boosted

    def alone(*args, **kwargs):
        seen.append(busy.acquire(blocking=False) and threading.current_thread() is threading.main_thread())
        try:
            return real(*args, **kwargs)
        finally:
            busy.release()

    monkeypatch.setattr(M, "boosted", alone)
    M.ablation(features, str(_day(30)), c=0.1, rounds=2, blocks={"a": ["sent_mean"], "b": ["ret_1d"]})
    assert seen == [True, True]


def test_all_years_are_fitted_together(spark, monkeypatch):
    from quillpanel.operators import newton

    calls, real = [], newton.fitted
    monkeypatch.setattr(newton, "fitted", lambda rows, parts, *rest: calls.append([p.upto for p in parts]) or real(rows, parts, *rest))
    u = lambda seed: F.xxhash64("id", F.lit(seed)) / float(2**63)
    rows = spark.range(1200).select(F.make_date(2018 + F.col("id") % 4, F.lit(1), F.lit(1) + F.col("id") % 7).alias("date"), u(1).alias("ret_1d"), u(2).alias("volume_z"), u(3).alias("_e"))
    rows = rows.withColumns({"fwd_ret_1d": F.col("ret_1d") + F.col("_e") / 4, "target_rel": (F.col("ret_1d") > 0).cast("int")}).drop("_e").cache()
    assert M.walk_forward_blend(rows, ["ret_1d", "volume_z"], {"ret_1d": -1.0}, least_history=300, least_names=5) == 1.0
    assert calls == [[2019.0, 2020.0, 2021.0]]


def test_leakage_comparison_reads_stored_features(spark, features, monkeypatch):
    read = []
    monkeypatch.setattr(EX, "features_at", lambda h, s, p, lag, *_: features)
    monkeypatch.setattr(M, "ablation", lambda df, *_, **__: read.append(df.inputFiles()) or spark.createDataFrame([("m", 0.5, 0.5)], "model string, accuracy double, roc_auc double"))
    assert EX.leakage_comparison(None, None, None).count() == 1
    assert len(read) == 2 and all("/tables/features-" in f for files in read for f in files) and all(read)
