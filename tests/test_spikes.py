"""Implausible readings: each rule, and the tail fit."""

import datetime as dt
import math
import random
import statistics

from pyspark.sql import functions as F

from quillpanel.operators.spikes import implausible, judged, readings

START = dt.date(2024, 1, 1)


def _series(n=150, seed=1, step=0.01):
    random.seed(seed)
    x = [100.0]
    for _ in range(n - 1):
        x.append(x[-1] * math.exp(random.gauss(0, step)))
    return x


def _frame(spark, series, **extra):
    rows = [(s, START + dt.timedelta(k), v, None) for s, xs in series.items() for k, v in enumerate(xs)]
    return spark.createDataFrame(rows, "s string, d date, v double, y double")


def _flagged(spark, series):
    out = implausible(judged(readings(_frame(spark, series), F.col("s"), F.col("d"), ["v"])))
    return {(r["source"], (r["day"] - START).days) for r in out.collect()}


def _brute(xs):
    flags = {k for k, v in enumerate(xs) if v is not None and not math.isnan(v) and v <= 0}
    seq = [(k, v, math.log(v)) for k, v in enumerate(xs) if v is not None and not math.isnan(v) and v > 0]
    if len(seq) < 2:
        return flags
    far = 10 * statistics.median(abs(b[2] - a[2]) for a, b in zip(seq, seq[1:]))
    for i in range(1, len(seq)):
        for n in (1, 2, 3):
            if i + n < len(seq):
                b, a, run = seq[i - 1][2], seq[i + n][2], [s[2] for s in seq[i : i + n]]
                if abs(a - b) <= far and (all(r - b > far and r - a > far for r in run) or all(b - r > far and a - r > far for r in run)):
                    flags |= {s[0] for s in seq[i : i + n]}
    i = 0
    while i < len(seq):
        j = i
        while j + 1 < len(seq) and seq[j + 1][1] == seq[i][1]:
            j += 1
        if j - i + 1 >= 6:
            flags |= {s[0] for s in seq[i + 1 : j + 1]}
        i = j + 1
    return flags


def test_matches_the_rules(spark):
    series = {}
    for s in range(8):
        xs = _series(seed=s, step=0.003 * (s + 1))
        xs[20] *= 3
        xs[40], xs[41] = xs[40] / 5, xs[41] / 4
        xs[60:63] = [v * 2.5 for v in xs[60:63]]
        xs[70:74] = [v * 2.5 for v in xs[70:74]]  # four: a level of its own
        xs[80:] = [v / 2 for v in xs[80:]]  # a split stays
        xs[90:96] = [xs[90]] * 6
        xs[100:105] = [xs[100]] * 5  # one too short
        xs[110], xs[111], xs[112], xs[113] = 0.0, -4.0, None, float("nan")
        xs[120] = xs[120] * 3 if s % 2 else 0.0
        xs[-1] *= 4  # no reading after it
        series[f"s{s}"] = xs
    want = {(s, k) for s, xs in series.items() for k in _brute(xs)}
    assert _flagged(spark, series) == want
    assert {("s0", 20), ("s0", 40), ("s0", 62), ("s0", 95), ("s0", 110)} <= want
    assert not {("s0", 70), ("s0", 80), ("s0", 90), ("s0", 104)} & want


def test_constant_short_and_empty(spark):
    series = {"flat": [5.0] * 10, "one": [3.0], "none": [None, None], "bad": [0.0]}
    assert _flagged(spark, series) == {("flat", k) for k in range(1, 10)} | {("bad", 0)}
    assert _flagged(spark, {}) == set()


def test_repeats_count_once_and_null_keys_are_left_out(spark):
    df = _frame(spark, {"a": _series(30)})
    more = df.unionByName(df).unionByName(spark.createDataFrame([(None, START, 1.0, 1.0), ("a", None, 1.0, 1.0)], df.schema))
    assert readings(more, F.col("s"), F.col("d"), ["v"]).count() == 30


def _tails(spark, series, **options):
    rows = judged(readings(_frame(spark, series), F.col("s"), F.col("d"), ["v"]), **options)
    return rows.groupBy("source").agg(*[F.max(c).alias(c) for c in ("usual", "threshold", "shape", "cutoff")], *[F.sum(F.col(c).cast("int")).alias(c) for c in ("peak", "rule", "spike")]).collect()


def test_tail_cutoff_lies_beyond_the_threshold_and_lets_few_in(spark):
    (r,) = _tails(spark, {"a": _series(2000)}, risk=1e-3)
    assert r["cutoff"] > r["threshold"] > 0 and r["peak"] <= 12 and abs(r["shape"]) < 0.5


def test_faulty_readings_do_not_move_the_tail(spark):
    clean = _series(1000)
    faulty = list(clean)
    for k in range(10, 1000, 37):
        faulty[k] *= 8
    (c,), (f,) = _tails(spark, {"a": clean}), _tails(spark, {"a": faulty})
    assert abs(f["cutoff"] / c["cutoff"] - 1) < 0.15 and f["cutoff"] < 10 * f["usual"]
    assert f["rule"] == f["spike"] == len(range(10, 1000, 37))


def test_the_fitted_tail_decides(spark):
    """Where far moves are what the source usually does, the cutoff lies beyond the spike distance: without the fit these runs would be flagged."""
    random.seed(5)
    xs = [100 * math.exp(0.0005 * math.tan(math.pi * (random.random() - 0.5))) for _ in range(900)]  # readings with errors that have no variance
    (r,), (loose,) = _tails(spark, {"a": xs}, risk=1e-4), _tails(spark, {"a": xs})
    assert r["cutoff"] > 10 * r["usual"] > loose["cutoff"]
    assert loose["spike"] == loose["rule"] == r["rule"] > r["spike"] > 0


def test_spikes_of_a_flat_series_with_a_weekly_step(spark):
    # Most changes are nothing, so any return is a spike; Mondays usually move, which must not hide one.
    xs = [100.0 * (1.01 if (k // 7) % 2 else 1.0) for k in range(140)]
    xs[50] = 100.5
    assert _flagged(spark, {"a": xs}) == {("a", k) for k in _brute(xs)}
