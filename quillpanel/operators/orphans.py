"""References to records that do not exist.

Keys are ranged over their 64-bit image, so ranges are even whatever the keys
look like. Each range's parents are one sorted array; Arrow batches of
references are probed into it by binary search. Only misses leave Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.keys import hash128
from quillpanel.operators.probe import MAX_BUCKETS, bucket_count, bucketed_probe


@dataclass(frozen=True)
class Parents:
    """Rows that may be referred to under ``relation``; a key with any row where ``withdrawn`` holds is none."""

    relation: str
    rows: DataFrame
    key: Sequence[Column]
    withdrawn: Column | None = None
    #: Rows that withdraw keys but do not make them exist.
    only_withdraws: bool = False


@dataclass(frozen=True)
class References:
    """Rows that refer to a parent: ``relation`` may differ by row, ``record`` names the row, ``period`` its period.

    ``rows`` must be a scan or a map over one (not a result of a shuffle), so that a row keeps its place when a task is run again.
    """

    table: str
    rows: DataFrame
    relation: Column
    key: Sequence[Column]
    record: Column
    period: Column


def find_orphans(parents: Sequence[Parents], references: Sequence[References], keys_per_range: int = 20_000, slice_rows: int = 1_000_000) -> DataFrame:
    """Rows ``(table_name, record_key, period)`` of references that lead nowhere, each once.

    - A null in any part of a reference's key leads nowhere; a null in a parent's key makes no parent.
    - Repeated parents and references count once. Empty parents make every reference an orphan.
    - Other columns of the inputs, whatever their names, are not looked at.

    One exchange carries parents and references, one removes repeats among the
    parents (map-side combined, so a parent repeated in a third of its table is
    one row per map task), one repeats among the misses.
    """
    sides = []
    for p in parents:
        whole = p.rows
        for k in p.key:
            whole = whole.where(k.isNotNull())
        h1, h2 = hash128(F.lit(p.relation), *p.key)
        gone = F.coalesce(p.withdrawn, F.lit(False)) if p.withdrawn is not None else F.lit(False)
        sides.append(whole.select(h1.alias("k1"), h2.alias("k2"), F.lit(not p.only_withdraws).alias("there"), gone.alias("gone")))
    union = sides[0]
    for s in sides[1:]:
        union = union.unionByName(s)
    n_ranges = bucket_count(sum(p.rows.count() for p in parents), keys_per_range)
    live = (
        union.groupBy("k1", "k2").agg(F.max("there").alias("there"), F.max("gone").alias("gone"))
        .where(F.col("there") & ~F.col("gone"))
        .select(key_range(F.col("k1"), n_ranges).alias("bucket"), "k1", "k2")
    )
    refs = None
    for r in references:
        h1, h2 = hash128(r.relation, *r.key)
        whole = F.lit(True)
        for k in r.key:
            whole = whole & k.isNotNull()
        rows = r.rows.select(
            h1.alias("r1"), h2.alias("r2"), whole.alias("whole"),
            F.lit(r.table).alias("table_name"), r.record.alias("record_key"), r.period.alias("period"),
        )
        refs = rows if refs is None else refs.unionByName(rows)
    refs = refs.withColumn("bucket", key_range(F.col("r1"), n_ranges))
    # Repeats of one reference may be a third of the rows: they are told apart by their place in the scan.
    missing = bucketed_probe(live, refs, _sorted_keys, _misses, "table_name string, record_key string, period string", slice_rows, F.monotonically_increasing_id())
    return missing.distinct()


def key_range(k1: Column, n: int) -> Column:
    """Which of ``n`` equal ranges of the signed 64-bit line ``k1`` lies in, in order."""
    width = -(-(1 << 64) // n)
    high = F.shiftright(k1, 16) + F.lit(1 << 47)  # 48 bits are enough to tell up to MAX_BUCKETS ranges apart
    assert n <= MAX_BUCKETS
    return F.least(F.floor(high / F.lit(float(width >> 16) if width >> 16 else 1.0)), F.lit(n - 1)).cast("int")


def _sorted_keys(parents: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    k1 = parents.column("k1").to_numpy()
    k2 = parents.column("k2").to_numpy()
    order = np.lexsort((k2, k1))
    return k1[order], k2[order]


def _misses(index: tuple[np.ndarray, np.ndarray], refs: pa.RecordBatch) -> pa.RecordBatch:
    k1, k2 = index
    r1 = refs.column(0).to_numpy(zero_copy_only=False)
    r2 = refs.column(1).to_numpy(zero_copy_only=False)
    found = np.zeros(len(r1), bool)
    if len(k1):
        at = np.searchsorted(k1, r1)
        open_ = np.arange(len(r1))
        while len(open_):  # keys with the same first half lie next to each other
            open_ = open_[at[open_] < len(k1)]
            open_ = open_[k1[at[open_]] == r1[open_]]
            hit = k2[at[open_]] == r2[open_]
            found[open_[hit]] = True
            open_ = open_[~hit]
            at[open_] += 1
    found &= refs.column(2).to_numpy(zero_copy_only=False).astype(bool)
    out = refs.select(["table_name", "record_key", "period"])
    return out.filter(pa.array(~found))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table and period."""
    return orphans.groupBy("table_name", "period").agg(F.count("*").alias("n_orphans"))
