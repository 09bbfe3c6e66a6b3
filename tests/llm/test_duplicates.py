"""Duplicates hidden by formatting."""

import pytest
from pyspark.sql import functions as F

from quillpanel.llm import duplicates as D

SCHEMA = "u string, t string, day string, title string, check string, copies string"


def _forms(spark, titles):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    return [r["f"] for r in df.orderBy("i").select("i", D.canonical(F.col("t")).alias("f")).orderBy("i").collect()]


@pytest.mark.parametrize("same", [
    ["Fenzor names team; sales delayed to Q3", "fenzor  names team sales DELAYED to q3 …", "[Fenzor​ names team;\tsales delayed to Q3!]"],
    ["A | B C | 12%", "12%|a|b c", " b c　| 12% | A ", "B-C|A|12%|"],
    ["rose 1,234,567 shares", "rose 1234567 shares"],
    ["full-year U.S. outlook", "Full year US outlook", "full‑year us outlook"],
    ["Straße", "STRASSE"],
])
def test_same(spark, same):
    assert len(set(_forms(spark, same))) == 1


@pytest.mark.parametrize("a,b", [
    ("up 2.34%", "up 234%"), ("by -5.6%", "by 5.6%"), ("Q3 2020", "Q32 020"), ("a 1 2", "a 12"), ("1,23 a", "123 a"), ("x .5", "x 5"), ("A|B", "AB"), ("a b|c", "a|b c"), ("-1 2", "1 -2"),
])
def test_different(spark, a, b):
    x, y = _forms(spark, [a, b])
    assert x != y


def test_odd_titles(spark):
    assert _forms(spark, [None, "", " \t", "|||", "...", "a" * 50_000]) == [None, "", "", "", "", "a" * 50_000]


def _member(spark, rows):
    return D.members(spark.createDataFrame(rows, SCHEMA), F.col("u"), [F.col("t"), F.col("day")], F.col("title"))


ROWS = [
    ("u1", "A", "1", "Big News", "", ""), ("u1", "A", "1", "Big News", "", ""), ("u2", "A", "1", "big news!", "", ""), ("u3", "A", "2", "big news!", "", ""),
    ("u4", None, None, None, "", ""), ("u5", None, None, None, "", ""), ("u6", None, None, "", "", ""), (None, "A", "1", "Big News", "", ""),
]


def test_records_and_pairs(spark):
    m = _member(spark, ROWS)
    assert sorted(tuple(r) for r in D.records(m).collect()) == [("u1", 3, 2), ("u3", 1, 1), ("u4", 2, 2), ("u6", 1, 1)]
    assert sorted(tuple(r) for r in D.pairs(m).collect()) == [("u1", "u2"), ("u4", "u5")]
    assert D.collisions(m).collect() == []


def test_a_hot_record(spark):
    rows = [(f"u{i:03d}", "A", "1", "x" + " " * i + "y", "", "") for i in range(60)]
    m = _member(spark, rows)
    assert D.pairs(m).count() == 60 * 59 // 2
    assert [tuple(r) for r in D.records(m).collect()] == [("u000", 60, 60)]


def test_collisions_are_told_apart(spark):
    m = spark.createDataFrame([(1, 2, 7, "a", 1), (1, 2, 8, "b", 1)], "h1 long, h2 long, check long, uid string, copies long")
    assert D.records(m).count() == 2 and D.pairs(m).count() == 0 and D.collisions(m).count() == 1


def test_empty(spark):
    m = _member(spark, [])
    assert D.records(m).collect() == [] and D.pairs(m).collect() == []


def test_characters_are_brought_to_one_form(spark):
    same = [("Caf\u00e9 ol\u00e9", "Cafe\u0301 ole\u0301"), ("ＦＵＬＬ １２", "full 12"), ("ﬁrst oﬃce", "first office"), ("up １．５ %", "up 1.5"), ("\u00dcnder", "U\u0308nder")]
    apart = [("10² m", "102 m"), ("½ off", "12 off"), ("resume", "résumé")]
    df = spark.createDataFrame([(a, b) for a, b in same + apart] + [(None, None)], "a string, b string")
    got = [r[0] for r in df.select(D.canonical(F.col("a")).eqNullSafe(D.canonical(F.col("b")))).collect()]
    assert got == [True] * len(same) + [False] * len(apart) + [True]


def test_classes_name_one_record_and_count_links(spark):
    rows = [("u3", "A b"), ("u1", "a B"), ("u1", "a B"), ("u2", "a-b"), ("u9", "other")]
    df = spark.createDataFrame(rows, "uid string, title string")
    m = D.members(df, F.col("uid"), [F.lit(1)], F.col("title"))
    assert {tuple(r) for r in D.classes(m).collect()} == {("u1", "u1", 2), ("u2", "u1", 2), ("u3", "u1", 2), ("u9", "u9", 0)}


def test_a_class_of_very_many_forms(spark):
    df = spark.range(400).select(F.format_string("u%03d", "id").alias("uid"), F.concat(F.lit("Same  title"), F.repeat(F.lit("!"), F.col("id").cast("int"))).alias("title"))
    m = D.members(df, F.col("uid"), [F.lit(1)], F.col("title"))
    assert D.pairs(m).count() == 400 * 399 // 2 and D.records(m).count() == 1
