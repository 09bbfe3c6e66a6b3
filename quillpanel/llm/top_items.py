"""The N best items of every group.

Each partition keeps, per group, its own N best and gives up everything below
its N-th: that item is a lower bound for the group's N-th best over all
partitions. What the partitions keep is stored; the highest bound per group is
joined to it, rows below it are dropped, and only what survives goes to the
ranking. No task ever holds more than N rows of a group per partition that fed
it, however many items a group has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions.keys import hash128
from quillpanel.runtime import write_table

#: Rows a worker holds before it gives up the survivors it has and starts over: bounds of a part are valid too.
HELD_ROWS = 400_000


def local_best(rows: DataFrame, group: Sequence[str], item: str, score: str, n: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """What each partition of ``rows`` keeps, with its bounds, stored: at most ``n`` rows per group and partition.

    A map over the partitions as they are: it moves no row.
    """
    keys = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)]
    names = [f"g{i}" for i in range(len(group))]
    items = rows.select(*keys, F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{score}`").cast("double").alias("score")).where("item is not null and score is not null and not isnan(score)")
    g1, g2 = hash128(*[F.col(g) for g in names])
    local = items.select(*names, "item", "score", g1.alias("g"), g2.alias("h"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in local.schema.fields) + ", bound_score double, bound_item string"
    return write_table(local.mapInArrow(_local_best(n, held_rows), schema), "local-best")


def within_bounds(best: DataFrame) -> DataFrame:
    """Rows of ``local_best`` that are not below the highest bound of their group.

    The bounds, one row a group, are an aggregate over a stored table, joined by
    an equality join: broadcast where their size is seen to allow it, else on the
    exchange by group that the ranking uses as well.
    """
    bound = F.min(F.struct((-F.col("bound_score")).alias("s"), F.col("bound_item").alias("i")))
    bounds = best.where("bound_score is not null").groupBy("g", "h").agg(bound.alias("b")).select("g", "h", (-F.col("b.s")).alias("least"), F.col("b.i").alias("least_item"))
    return best.join(bounds, ["g", "h"], "left").where("least is null or score > least or (score = least and item <= least_item)")


def top_n(rows: DataFrame, group: Sequence[str], item: str, score: str, n: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """``(*group, item, score)``: per group the ``n`` items with the highest score, ties by item ascending.

    - An item that occurs more than once in a group counts once, with its highest
      score, wherever its rows lie: a partition's bound is that of its different items.
    - Null and NaN scores, and null items, are left out; nulls in ``group`` form groups.
    - Groups with fewer than ``n`` items give all; no rows give none.
    - Other columns, whatever their names, are not carried.

    ``rows`` are read once and pruned before they are exchanged; repeated rows of
    one partition go there as well.
    """
    names = [f"g{i}" for i in range(len(group))]
    kept = within_bounds(local_best(rows, group, item, score, n, held_rows))
    by_group = kept.select("g", "h", *names, "item", "score").repartition("g", "h")
    once = by_group.groupBy("g", "h", *names, "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("g", "h").orderBy(F.desc("score"), "item"))
    ranked = once.select(*names, "item", "score", place.alias("place")).where(F.col("place") <= n)
    return ranked.select(*[F.col(a).alias(g) for a, g in zip(names, group)], F.col("item").alias(item), F.col("score").alias(score))


def _local_best(n: int, held_rows: int):
    def best_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The n best per group in order; the place of each in its group, and the number of its group."""
        table = table.take(pc.sort_indices(table, sort_keys=[("g", "ascending"), ("h", "ascending"), ("item", "ascending"), ("score", "descending")]))
        g, h, item = table.column("g").to_numpy(), table.column("h").to_numpy(), table.column("item").combine_chunks()
        if len(g):  # an item's highest score
            other = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | pc.not_equal(item[1:], item[:-1]).to_numpy(zero_copy_only=False)))
            table = table.filter(pa.array(other))
        table = table.take(pc.sort_indices(table, sort_keys=[("g", "ascending"), ("h", "ascending"), ("score", "descending"), ("item", "ascending")]))
        g, h = table.column("g").to_numpy(), table.column("h").to_numpy()
        first = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))) if len(g) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
        keep = np.arange(len(g)) - start < n
        return table.filter(pa.array(keep)), (np.arange(len(g)) - start)[keep], np.cumsum(first)[keep]

    def survivors(table: pa.Table) -> pa.RecordBatch:
        table, place, g = best_of(table)
        # The n-th of its group, where there is one, is the bound of the group in this part.
        at = np.flatnonzero(place == n - 1)
        where = np.searchsorted(g[at], g)
        has = (where < len(at)) & (g[at[np.minimum(where, len(at) - 1)]] == g) if len(at) else np.zeros(len(g), bool)
        index = pa.array(np.where(has, at[np.minimum(where, max(0, len(at) - 1))] if len(at) else 0, 0), mask=~has)
        table = table.append_column("bound_score", table.column("score").take(index)).append_column("bound_item", table.column("item").take(index))
        return table.combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= held_rows:
                table, _, _ = best_of(pa.Table.from_batches(held))
                if table.num_rows > held_rows // 2:  # too many groups to hold: these survivors go on as they are
                    yield from survivors(table).to_batches()
                    held, rows = [], 0
                else:
                    held, rows = table.combine_chunks().to_batches(), table.num_rows
        if rows:
            yield from survivors(pa.Table.from_batches(held)).to_batches()

    return run
