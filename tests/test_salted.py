"""Salted aggregation against brute force."""

import random

from pyspark.sql import functions as F

from quillpanel.operators.salted import heavy_keys, salted_summary

SCHEMA = "k string, at timestamp_ntz, title string, pub string, salt string, heavy_key string"


def _rows(n=2000):
    import datetime as dt

    random.seed(5)
    rows = []
    for i in range(n):
        k = random.choice(["hot"] * 6 + [None, "a", "b", f"k{i % 40}"])
        at = None if i % 11 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=random.randrange(5000))
        rows.append((k, at, random.choice([None, "", f"t{random.randrange(300)}"]), random.choice([None, "p", "q"]), "s", None))
    return rows + rows[:300]


def test_matches_brute_force(spark):
    rows = _rows()
    out = salted_summary(spark.createDataFrame(rows, SCHEMA), F.col("k"), F.col("at"), {"n_titles": F.col("title"), "n_pubs": F.col("pub")}, share=0.1)
    got = {r["key"]: (r["n"], r["first"], r["last"], r["n_titles"], r["n_pubs"]) for r in out.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = {r for r in rows if r[0] == k}
        ats = [r[1] for r in own if r[1]]
        want[k] = (len(own), min(ats, default=None), max(ats, default=None), len({r[2] for r in own} - {None}), len({r[3] for r in own} - {None}))
    assert got == want


def test_heavy_keys_are_few_and_spread(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    heavy = {r["heavy_key"]: r["salts"] for r in heavy_keys(df, F.col("k"), 0.2, 0.05).collect()}
    assert list(heavy) == ["hot"] and heavy["hot"] >= 10


def test_one_key_alone_and_empty(spark):
    one = spark.createDataFrame([("x", None, None, None, None, None)] * 50, SCHEMA)
    assert [tuple(r) for r in salted_summary(one, F.col("k"), F.col("at"), {"n_titles": F.col("title")}).collect()] == [("x", 1, None, None, 0)]
    assert salted_summary(one.where("false"), F.col("k"), F.col("at"), {"n_titles": F.col("title")}).collect() == []
