"""Ranks, correlations, p-values, stability, windows: hand-computed values and numpy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillpanel.functions import numbers as N
from quillpanel.functions import stats, windows


def test_p_values():
    assert stats.spearman_p(2.228 / math.sqrt(2.228**2 + 10), 12) == pytest.approx(0.05, abs=1e-4)
    assert stats.spearman_p(0.0042, 35526) == pytest.approx(0.4286, abs=1e-3)
    assert -194 < math.log10(stats.spearman_p(0.218, 18000)) < -190
    assert stats.spearman_p(0.0, 10) == pytest.approx(1.0)
    assert stats.spearman_p(1.0, 10) == 0.0 and stats.spearman_p(None, 10) is None and stats.spearman_p(0.5, 2) is None


def _spearman(spark, x, y, by=None):
    df = spark.createDataFrame([(k, a, b) for k, a, b in zip(by or [0] * len(x), x, y)], "k long, x double, y double")
    return {r["k"]: (r["rho"], r["n"]) for r in stats.pooled_spearman(df, "k", "x", "y").collect()}


def test_spearman_with_ties_and_nulls(spark):
    rho, n = _spearman(spark, [1.0, 1.0, 2.0, 4.0, None], [2.0, 3.0, 1.0, 4.0, 9.0])[0]
    assert rho == pytest.approx(0.316228, abs=1e-6) and n == 4
    assert _spearman(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0])[0] == (None, 3)
    assert _spearman(spark, [], []) == {}


def test_spearman_equals_pandas_over_many_ranges(spark):
    random.seed(1)
    by = [random.randrange(2) for _ in range(4000)]
    x = [round(random.gauss(0, 1), random.choice([0, 3])) for _ in by]
    y = [a + random.gauss(0, 2) for a in x]
    df = pd.DataFrame({"k": by, "x": x, "y": y})
    got = _spearman(spark, x, y, by)
    for k, g in df.groupby("k"):
        want = g["x"].rank().corr(g["y"].rank())
        assert got[k][0] == pytest.approx(want, abs=1e-12) and got[k][1] == len(g)


def _psi(spark, e, a):
    f = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    return stats.psi(f(e), f(a), "x").first()[0]


def test_psi(spark):
    """Against the sum over numpy's own bins, on a skewed population and one with fewer high values."""
    rng = np.random.default_rng(41)
    was, now = rng.exponential(2.0, 1800), rng.exponential(1.3, 700)
    edges = np.quantile(was, np.linspace(0, 1, 11))
    share = lambda v: np.clip(np.bincount(np.searchsorted(edges[1:-1], v, side="right"), minlength=10) / len(v), 1e-6, None)
    e, a = share(was), share(now)
    assert _psi(spark, was, now) == pytest.approx(float(((a - e) * np.log(a / e)).sum()), abs=1e-12)
    assert _psi(spark, was, was[::-1]) == pytest.approx(0.0, abs=1e-12)
    assert _psi(spark, was[:7], now) is None and _psi(spark, now, was[:7]) is None and _psi(spark, [3.0] * 40, now) is None
    assert _psi(spark, [*was, math.nan, -math.inf], now) == _psi(spark, was, now)


def test_psi_by_group(spark):
    rng = np.random.default_rng(42)
    was = rng.uniform(0, 1, 900)
    groups = {"low": rng.uniform(0, 0.5, 300), "same": rng.uniform(0, 1, 300), "few": rng.uniform(0, 1, 9)}
    e = spark.createDataFrame([(float(x),) for x in was], "x double")
    a = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    got = {r["g"]: r["psi"] for r in stats.psi(e, a, "x", by="g").collect()}
    assert got["few"] is None and got["low"] == pytest.approx(_psi(spark, was, groups["low"])) and got["same"] == pytest.approx(_psi(spark, was, groups["same"]))


@pytest.mark.parametrize("n", [3, 50, 10_000])
def test_ranks_places_and_quantiles_over_many_ranges(spark, n):
    """Ranges of three values or of fifty give what one range gives; a value held by a third of the rows lies in several ranges of places."""
    rng = np.random.default_rng(43)
    x = [0.0 if rng.random() < 0.33 else float(v) for v in rng.integers(-40, 40, 400)]
    df = spark.createDataFrame([(k, "g" if k % 3 else "h", v) for k, v in enumerate(x)], "k int, g string, x double").cache()
    want = pd.DataFrame({"g": ["g" if k % 3 else "h" for k in range(400)], "x": x}).groupby("g")["x"].rank()
    got = {r["k"]: r["r"] for r in stats.with_pooled_rank(df, "g", "x", "r", n).collect()}
    assert [got[k] for k in range(400)] == want.tolist()
    placed = sorted((r["p"], r["x"], r["k"]) for r in stats.with_place(df, ["x", "k"], "p", n).collect())
    assert [p for p, _, _ in placed] == list(range(1, 401)) and [v[1:] for v in placed] == sorted(zip(x, range(400)))
    at = [0, 0.1, 0.5, 0.77, 1]
    assert stats.exact_quantiles(df, "x", at, n) == pytest.approx(np.quantile(x, at).tolist(), abs=1e-12)
    assert stats.exact_quantiles(df.limit(0), "x", at, n) == []


@pytest.mark.parametrize("q", [2, 4, 5])
def test_buckets_are_those_of_equal_ranks(spark, q):
    for n in (5, 7, 100, 101):
        rows = spark.range(1, n + 1).select(stats.quantile_bucket(F.col("id"), F.lit(n), q).alias("b")).collect()
        want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=False) + 1
        assert sorted(r["b"] for r in rows) == sorted(want)
    assert spark.range(1).select(stats.quantile_bucket(F.lit(1), F.lit(1), q)).first()[0] == 1


def test_ewma_skips_nulls(spark):
    x = [None, 0.2, None, -0.4, 0.9, None, 0.1]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").where("x is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    got = [r["e"] for r in df.select("k", windows.ewma(F.col("x"), w).alias("e")).orderBy("k").collect()]
    assert got == pytest.approx([0.2, -0.2, 0.428571, 0.253333], abs=1e-6)
    want = pd.Series(x).ewm(span=3, ignore_na=True, min_periods=1).mean()[[1, 3, 4, 6]]
    assert got == pytest.approx(list(want), abs=1e-12)


def test_rolling_windows_equal_pandas(spark):
    random.seed(2)
    x = [None if random.random() < 0.2 else random.gauss(0, 1) for _ in range(80)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double")
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    c = F.col("x")
    got = df.select("k", windows.rolling_mean(c, w, 10, 3).alias("m"), windows.rolling_std(c, w, 5, 3).alias("s"), windows.rolling_z(c, w, 20, 5).alias("z"), windows.change(c, w, 5).alias("c"), windows.forward_change(c, w).alias("f")).orderBy("k").toPandas()
    s = pd.Series(x, dtype=float)
    m20, s20 = s.rolling(20, min_periods=5).mean(), s.rolling(20, min_periods=5).std()
    for col, want in {"m": s.rolling(10, min_periods=3).mean(), "s": s.rolling(5, min_periods=3).std(), "z": (s - m20) / (s20 + 1e-9), "c": s / s.shift(5) - 1, "f": s.shift(-1) / s - 1}.items():
        np.testing.assert_allclose(got[col].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-12)


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0, float("nan"), None), (4.0, 2.0, float("inf"), 3.0)], "a double, b double, c double, d double")
    rows = df.select(
        N.ratio(F.col("a"), F.col("b")).alias("r"), N.finite(F.col("c")).alias("f"), N.row_mean([F.col("a"), F.col("d")]).alias("m"), N.up_label(F.col("c")).alias("u"),
        N.squash(F.lit(0.0), 10.0).alias("s"), N.weighted_sum({"a": 2.0, "zz": 9.0}, df.columns).alias("w"), N.score_label(F.lit(0.15)).alias("l"),
    ).collect()
    assert [r["r"] for r in rows] == [None, 2.0] and [r["f"] for r in rows] == [None, None] and [r["u"] for r in rows] == [None, None]
    assert [r["m"] for r in rows] == [1.0, 3.5] and rows[0]["s"] == 0.5 and [r["w"] for r in rows] == [2.0, 8.0] and rows[0]["l"] == "neu"
