"""Top items per group against brute force."""

import random

from quillpanel.llm import top_items
from quillpanel.llm.top_items import top_n

SCHEMA = "a string, b string, i string, s double, score double, item string, g long, place int"


def _brute(rows, n):
    best = {}
    for a, b, i, s in rows:
        if i is not None and s is not None and s == s:
            best[a, b, i] = max(s, best.get((a, b, i), -float("inf")))
    groups = {}
    for (a, b, i), s in best.items():
        groups.setdefault((a, b), []).append((-s, i))
    return {(a, b, i, -s) for (a, b), v in groups.items() for s, i in sorted(v)[:n]}


def _got(spark, rows, n, **options):
    df = spark.createDataFrame([(*r, 1.0, "x", 7, 8) for r in rows], SCHEMA)
    return [tuple(r) for r in top_n(df, ["a", "b"], "i", "s", n, **options).collect()]


def _rows(seed, n=3000):
    random.seed(seed)
    return [(random.choice(["hot", "hot", None, f"a{random.randrange(30)}"]), random.choice([None, "x"]), random.choice([None, *[f"i{random.randrange(400)}"] * 9]), random.choice([None, float("nan"), round(random.random(), 1), random.random(), float("inf")])) for _ in range(n)]


def test_matches_brute_force_with_ties_and_repeats(spark):
    for seed in (1, 2):
        rows = _rows(seed)
        got = _got(spark, rows + rows[:500], 5)
        assert len(got) == len(set(got)) and set(got) == _brute(rows, 5)


def test_survivors_handed_on_early(spark):
    rows = _rows(3)
    assert set(_got(spark, rows, 3, held_rows=40)) == _brute(rows, 3)


def test_bounds_drop_rows_before_the_ranking(spark):
    df = spark.createDataFrame([("a", "b", f"i{k:05d}", k / 20000) for k in range(20000)], "a string, b string, i string, s double").repartition(8)
    best = top_items.local_best(df, ["a", "b"], "i", "s", 5)
    kept = top_items.within_bounds(best).count()
    assert best.count() <= 40 and 5 <= kept < 40


def test_repeats_of_an_item_in_many_partitions(spark):
    rows = [("a", "b", "same", 0.9)] * 4000 + [("a", "b", f"i{k}", k / 1000) for k in range(500)]
    assert set(_got(spark, rows, 4)) == _brute(rows, 4)


def test_all_equal(spark):
    rows = [("a", "b", f"i{k:04d}", 0.5) for k in range(2000)]
    assert sorted(_got(spark, rows, 3)) == [("a", "b", f"i{k:04d}", 0.5) for k in range(3)]


def test_few_and_none(spark):
    assert _got(spark, [("a", "b", "i", 1.0)], 5) == [("a", "b", "i", 1.0)]
    assert _got(spark, [], 5) == []
    assert _got(spark, [("a", "b", "i", None)], 5) == []
