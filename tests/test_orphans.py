"""Orphan references: against brute force, with every odd case."""

import random

from pyspark.sql import functions as F

from quillpanel.operators.orphans import Parents, References, find_orphans, key_range, orphan_report


def _orphans(spark, parents, refs, removed=(), slice_rows=1_000_000, keys_per_range=20_000):
    p = spark.createDataFrame([(k,) for k in parents], "k string")
    x = spark.createDataFrame([(k,) for k in removed], "k string")
    r = spark.createDataFrame(refs, "id string, k string, month string, k1 long, bucket string")
    out = find_orphans(
        [Parents("t", p, [F.col("k")]), Parents("t", x, [F.col("k")], withdrawn=F.lit(True), only_withdraws=True)],
        [References("refs", r, F.lit("t"), [F.col("k")], F.col("id"), F.col("month"))], keys_per_range, slice_rows,
    )
    return out


def test_matches_brute_force_with_hot_keys_and_slices(spark):
    random.seed(1)
    parents = [f"p{i}" for i in range(500)] * 2
    refs = [(f"r{i}", random.choice(["hot", f"p{random.randrange(700)}"]), "2024-01", i, "x") for i in range(3000)]
    removed = [f"p{i}" for i in range(0, 500, 7)]
    got = {(r["table_name"], r["record_key"]) for r in _orphans(spark, parents, refs, removed, slice_rows=50, keys_per_range=20).collect()}
    live = set(parents) - set(removed)
    assert got == {("refs", i) for i, k, *_ in refs if k not in live}


def test_nulls_repeats_and_empty_tables(spark):
    refs = [("a", None, "2024-01", 1, None), ("a", None, "2024-01", 1, None), ("b", "p", None, None, None), ("c", "q", "2024-02", 2, "y")]
    got = sorted((r["record_key"], r["period"]) for r in _orphans(spark, ["p", None], refs).collect())
    assert got == [("a", "2024-01"), ("c", "2024-02")]
    assert sorted(r["record_key"] for r in _orphans(spark, [], refs).collect()) == ["a", "b", "c"]
    assert _orphans(spark, ["p"], []).collect() == []


def test_report_counts_each_once(spark):
    refs = [("a", "x", "2024-01", 1, ""), ("a", "x", "2024-01", 2, ""), ("b", "x", "2024-02", 3, "")]
    rows = {(r["table_name"], r["period"]): r["n_orphans"] for r in orphan_report(_orphans(spark, ["p"], refs)).collect()}
    assert rows == {("refs", "2024-01"): 1, ("refs", "2024-02"): 1}


def test_ranges_are_in_order_and_even(spark):
    n = 100
    df = spark.range(20000).select(F.xxhash64("id").alias("k")).select("k", key_range(F.col("k"), n).alias("r"))
    rows = df.orderBy("k").collect()
    ranges = [x["r"] for x in rows]
    assert ranges == sorted(ranges) and min(ranges) == 0 and max(ranges) == n - 1
    assert max(ranges.count(r) for r in range(n)) < 400
    ends = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "k long").select(key_range(F.col("k"), n).alias("r")).collect()
    assert [x["r"] for x in ends] == [0, n - 1]
