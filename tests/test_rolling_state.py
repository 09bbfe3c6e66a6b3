"""Rolling totals: the three ways to a state agree with a plain sum."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillpanel.operators import rolling_state as RS

START = dt.date(2024, 1, 1)
PERIODS = (7, 30)


def _daily(spark, rows):
    df = spark.createDataFrame(rows, "t string, d date, v double, version string, day string")
    return RS.daily_amounts([(df, F.col("t"), F.col("d"), {"v": F.col("v")})], {"v": 2}, anchor="v")


def _brute(rows):
    value, span = {}, {}
    for t, d, v, *_ in rows:
        if t is None or d is None:
            continue
        lo, hi = span.get(t, (d, d))
        span[t] = (min(lo, d), max(hi, d))
        if v is not None and v == v:
            value[t, d] = max(value.get((t, d), v), v)
    out = {}
    for t, (lo, hi) in span.items():
        for k in range((hi - lo).days + 1):
            d = lo + dt.timedelta(k)
            row = []
            for p in PERIODS:
                vs = [value[t, d - dt.timedelta(j)] for j in range(p) if (t, d - dt.timedelta(j)) in value]
                beyond = any(abs(v) > 1e20 for v in vs)
                row += [None if beyond else round(sum(vs), 2), None if beyond or not vs else sum(vs) / len(vs), len(vs)]
            out[t, d] = tuple(row)
    return out


def _published(state):
    state = state if "version" in state.columns else state.withColumn("version", F.lit(0))
    rows = RS.publish(state, ["v"], PERIODS).collect()
    out = {(r["entity"], r["day"]): tuple(r[f"v_{k}_{p}"] for p in PERIODS for k in ("total", "avg", "days")) for r in rows}
    assert len(out) == len(rows)
    return out


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (k, a[k], b[k])


def _rows(n=60):
    random.seed(3)
    rows = []
    for t in ("A", "B"):
        for k in range(n):
            if random.random() < 0.6 or k in (0, n - 1):
                rows.append((t, START + dt.timedelta(k), random.choice([1.25, -3.5, 7.0, None, float("nan")]), "x", "y"))
    rows += [("E", START, 2.0, "", ""), ("E", START + dt.timedelta(55), 4.0, "", ""), ("E", START + dt.timedelta(60), 1e200, "", "")]  # a long silence; too large to add
    return rows + rows[:5] + [(None, START, 1.0, "", ""), ("A", None, 1.0, "", ""), ("C", START, 1e300, "", ""), ("C", START + dt.timedelta(40), float("inf"), "", ""), ("C", START + dt.timedelta(64), 3.0, "", ""), ("D", START, None, "", "")]


def test_bootstrap(spark):
    rows = _rows()
    _same(_published(RS.bootstrap(_daily(spark, rows), ["v"], PERIODS)), _brute(rows))


def _days(daily, *days):
    return daily.where(F.col("day").isin([START + dt.timedelta(k) for k in days]))


def test_steps_and_corrections_reach_the_same(spark):
    """Steps over more than the longest period, so that they take off what they have put on; corrections of first days, of days in
    a gap, of an entity the state has never seen, of days that steps wrote, and of an amount that was wrong."""
    rows = _rows(64) + [("F", START + dt.timedelta(3), 5.0, "", "")]
    daily = _daily(spark, rows).cache()
    late = F.col("day").isin([START + dt.timedelta(k) for k in (0, 3, 10, 45, 50)])
    state = RS.RollingState(spark, ["v"], PERIODS)
    state.load(daily.where(~late), START + dt.timedelta(30))
    wrong = daily.where(F.col("day") == F.lit(START + dt.timedelta(60))).withColumn("v", F.col("v") + 1)
    for k in range(31, 65):
        state.advance(wrong if k == 60 else daily.where(~late))
        if k == 55:
            state.correct(daily.where(late))
    state.correct(_days(daily, 60))
    _same(_published(state.read()), _brute(rows))


def test_a_step_reads_its_days_only(spark):
    daily = _daily(spark, [("A", START + dt.timedelta(k), 1.0, "", "") for k in range(60)])
    state = RS.RollingState(spark, ["v"], PERIODS)
    state.load(daily, START + dt.timedelta(58))
    seen = []
    keep = state._write
    state._write = lambda rows: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), keep(rows))
    state.advance(daily)
    assert "PartitionFilters: [kept" in seen[0] or "PartitionFilters: [isnotnull(kept" in seen[0], seen[0]


def test_a_correction_after_the_last_day_is_an_error(spark):
    import pytest

    daily = _daily(spark, [("A", START, 1.0, "", ""), ("A", START + dt.timedelta(9), 1.0, "", "")])
    state = RS.RollingState(spark, ["v"], PERIODS)
    state.load(daily, START)
    with pytest.raises(ValueError):
        state.correct(_days(daily, 9))
    state.correct(daily.limit(0))
    assert state.version == 0


def test_corrections_write_only_what_they_touch(spark):
    rows = [("A", START + dt.timedelta(k), 1.0, "", "") for k in range(50)]
    daily = _daily(spark, rows)
    state = RS.bootstrap(daily, ["v"], PERIODS)
    fix = _daily(spark, [("A", START + dt.timedelta(5), 3.0, "", ""), ("Z", START + dt.timedelta(48), 2.0, "", "")])
    new = RS.correct(state.withColumn("version", F.lit(0)), fix, ["v"], PERIODS, F.lit(START + dt.timedelta(49))).collect()
    assert sorted(r["day"] for r in new if r["entity"] == "A") == [START + dt.timedelta(k) for k in range(5, 35)]
    assert {r["v_total_7"] for r in new if r["entity"] == "A" and r["day"] < START + dt.timedelta(12)} == {8, 9}
    assert sorted(r["day"] for r in new if r["entity"] == "Z") == [START + dt.timedelta(k) for k in (48, 49)]


def test_amounts_are_exact(spark):
    rows = [("A", START + dt.timedelta(k), v, "", "") for k, v in enumerate([1e16, 0.25, 0.5, -1e16])]
    assert _published(RS.bootstrap(_daily(spark, rows), ["v"], PERIODS))["A", START + dt.timedelta(3)][0] == 0.75


def test_empty(spark):
    assert _published(RS.bootstrap(_daily(spark, []), ["v"], PERIODS)) == {}
    state = RS.RollingState(spark, ["v"], PERIODS)
    state.load(_daily(spark, []), START)
    state.advance(_daily(spark, []))
    assert _published(state.read()) == {}
