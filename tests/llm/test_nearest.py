"""Nearest moments: the tries against bisection, the operator against brute force."""

import bisect
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpanel.llm.nearest import XFastTries, pair_nearest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1023)), max_size=40), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1023)), min_size=1, max_size=40))
def test_neighbours(leaves, queries):
    table = pa.table({"m_tree": pa.array([x for x, _ in leaves], pa.int64()), "m_tree2": pa.array([-x for x, _ in leaves], pa.int64()), "m_at": pa.array([a for _, a in leaves], pa.int64()), "moment_id": pa.array(range(len(leaves)), pa.int64())})
    tries = XFastTries(table, 10)
    before, after = tries.neighbours(*(np.array(c, np.int64) for c in zip(*[(x, -x, a) for x, a in queries])))
    for (x, a), b, c in zip(queries, before, after):
        own = sorted({v for y, v in leaves if y == x})
        k = bisect.bisect_right(own, a)
        assert (tries.at[b] if b >= 0 else None) == (own[k - 1] if k else None)
        k = bisect.bisect_left(own, a)
        assert (tries.at[c] if c >= 0 else None) == (own[k] if k < len(own) else None)


def _pairs(spark, queries, moments, tol, **options):
    q = spark.createDataFrame(queries, "id string, e string, t long, block string")
    m = spark.createDataFrame(moments, "e string, t long, id long, bucket string")
    out = pair_nearest(q, m, query_id=F.col("id"), query_entity=F.col("e"), query_micros=F.col("t"), entity=F.col("e"), moment_micros=F.col("t"), moment_id=F.col("id"), tolerance_micros=tol, **options)
    return sorted(tuple(r) for r in out.collect())


def _brute(queries, moments, tol):
    out = set()
    for i, e, t, _ in queries:
        if None in (i, e, t):
            continue
        near = [(abs(t - m), m, k) for f, m, k, _ in moments if f == e and None not in (m, k) and abs(t - m) <= tol]
        if near:
            d, _, k = min(near)
            out.add((i, k, d))
    return sorted(out)


def test_operator(spark):
    random.seed(4)
    moments = [(random.choice(["a", "b", "c", None]), random.randrange(-5000, 5000), k, "x") for k in range(300)] + [("a", None, 1, ""), ("a", 3, None, "")]
    queries = [(f"q{k}", random.choice(["a", "a", "b", "zz", None]), random.choice([0, random.randrange(-6000, 6000)]), "x") for k in range(400)] + [("n", "a", None, ""), (None, "a", 1, "")]
    want = _brute(queries, moments, 20)
    for bits, rows, held in ((7, 7, 1000), (0, 1000, 1000), (17, 1, 1000), (14, 100, 4)):
        assert _pairs(spark, queries + queries[:50], moments + moments[:50], 20, block_bits=bits, slice_rows=rows, moments_per_block=held) == want


def test_a_dense_entity_beside_a_sparse_one(spark):
    """Blocks far shorter than the tolerance for the one, gaps longer than it, and empty blocks between a query and its moment."""
    random.seed(9)
    moments = [("dense", 5000 + k // 2, k, "") for k in range(800)] + [("dense", 90_000, 900, "")] + [("sparse", k * 3000, k, "") for k in range(40)]
    moments += [("dense", 5000, 0, "")] * 300
    queries = [(f"q{k}", random.choice(["dense", "sparse"]), random.randrange(-2000, 120_000), "") for k in range(300)] + [(f"d{k}", "dense", 5000 + k * 7, "") for k in range(60)]
    assert _pairs(spark, queries, moments, 1000, block_bits=17, moments_per_block=10) == _brute(queries, moments, 1000)


def test_ties_tolerance_and_empty(spark):
    m = [("a", 0, 1, ""), ("a", 20, 2, ""), ("a", 20, 0, "")]
    assert _pairs(spark, [("q", "a", 10, ""), ("r", "a", 31, ""), ("s", "a", 30, ""), ("u", "a", 20, "")], m, 10) == [("q", 1, 10), ("s", 0, 10), ("u", 0, 0)]
    assert _pairs(spark, [], m, 10) == []
    assert _pairs(spark, [("q", "a", 10, "")], [], 10) == []
