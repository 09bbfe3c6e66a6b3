"""Each record paired with the nearest moment of the same entity, by x-fast tries.

Moments of an entity within a block of time are the leaves of a binary trie over
their bits. Every prefix that occurs is an entry of one hash table, keyed by
(entity, length, prefix) and pointing at the least and greatest leaf below it.
A query's longest prefix in the table is found by binary search over the length;
the pointers there give predecessor and successor, the nearer of which counts.

An entity's time is cut into blocks, shorter ones where its moments are dense.
A block's trie holds the block's moments and the nearest one on either side of
it, if that is within the tolerance. So no trie grows with an entity's history or
density, a hot entity is spread over its blocks, and a hot block over slices
(see the probe).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.operators.probe import bucket_count, bucketed_probe
from quillpanel.runtime import write_table

#: Buckets at least, so that small inputs still use the cluster.
LEAST_BUCKETS = 64
#: Blocks of 2 ** 42 microseconds, about 51 days.
BLOCK_BITS = 42


def pair_nearest(
    queries: DataFrame, moments: DataFrame, *, query_id: Column, query_entity: Column, query_micros: Column,
    entity: Column, moment_micros: Column, moment_id: Column, tolerance_micros: int,
    block_bits: int = BLOCK_BITS, moments_per_block: int = 20_000, moments_per_bucket: int = 20_000, slice_rows: int = 500_000,
) -> DataFrame:
    """``(query_id string, moment_id bigint, distance bigint)`` for each query with a moment within the tolerance, included.

    - Of two equally near moments the earlier counts; of equal moments the one with the least id.
    - Repeated queries (same id, entity and time) count once, repeated moments once.
      A query id at several times or entities may have several moments, each with its least distance.
    - Rows with a null id, entity or time, on either side, pair with nothing.
    - Either side may be empty; the result then is.

    ``queries`` must be a scan or a map over one, so that a row keeps its place
    when a task is run again. Blocks are of ``2 ** block_bits`` microseconds,
    halved for an entity until it has about ``moments_per_block`` in its fullest.
    """
    q = queries.select(query_id.cast("string").alias("query_id"), query_entity.alias("entity"), query_micros.alias("t")).where("query_id is not null and entity is not null and t is not null")
    m = moments.select(entity.alias("entity"), moment_micros.alias("t"), moment_id.cast("long").alias("moment_id")).where("entity is not null and t is not null and moment_id is not null")
    filled = write_table(m.groupBy("entity", F.shiftright("t", block_bits).alias("block")).agg(F.approx_count_distinct("t").alias("n")), "blocks")
    n_buckets = bucket_count(filled.agg(F.sum("n")).first()[0] or 0, moments_per_bucket, LEAST_BUCKETS)
    halvings = F.ceil(F.log2(F.col("n") / moments_per_block)).cast("int")
    dense = write_table(filled.groupBy("entity").agg(F.max("n").alias("n")).where(F.col("n") > moments_per_block).select("entity", F.least(halvings, F.lit(block_bits)).alias("halved")), "dense")

    def blocked(df: DataFrame) -> DataFrame:
        # Few entities are dense, if any: their table is stored, so its size is seen when the join is planned.
        bits = F.lit(block_bits) - F.coalesce("halved", F.lit(0))
        return df.join(dense, "entity", "left").withColumn("bits", bits).withColumn("block", F.call_function("shiftright", F.col("t"), F.col("bits"))).drop("halved")

    own = blocked(m.groupBy("entity", "t").agg(F.min("moment_id").alias("moment_id")))
    ends = own.groupBy("entity", "bits", "block").agg(F.min(F.struct("t", "moment_id")).alias("first"), F.max(F.struct("t", "moment_id")).alias("last"))
    in_order = Window.partitionBy("entity").orderBy("block")  # rows are blocks, not moments
    start_of = lambda block: F.call_function("shiftleft", block, F.col("bits"))
    beside = ends.withColumns({"before": F.lag("block").over(in_order), "after": F.lead("block").over(in_order)})
    far = F.lit(tolerance_micros).cast("long")
    # The last moment of a block serves the blocks up to the next that has moments, the first those back to the one before, as far as the tolerance goes.
    upto = F.least(F.coalesce("after", F.lit(2**62)), F.call_function("shiftright", F.col("last.t") + far, F.col("bits")))
    back = F.greatest(F.coalesce("before", F.lit(-(2**62))), F.call_function("shiftright", F.col("first.t") - far, F.col("bits")))
    runs = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi))
    later = beside.select("entity", "bits", F.explode(runs(F.col("block") + 1, upto)).alias("block"), "last.t", "last.moment_id")
    earlier = beside.select("entity", "bits", F.explode(runs(back, F.col("block") - 1)).alias("block"), "first.t", "first.moment_id")
    build = own.select(*later.columns).unionByName(later).unionByName(earlier)

    def placed(df: DataFrame, tag: str, *rest: str) -> DataFrame:
        tree = F.xxhash64("entity", "block", "bits")
        offset = F.col("t") - start_of(F.col("block")) + far  # in [0, size + 2 * tolerance]
        return df.select(F.pmod(tree, F.lit(n_buckets)).cast("int").alias("bucket"), tree.alias(f"{tag}_tree"), F.xxhash64(F.lit(5), "block", "entity").alias(f"{tag}_tree2"), offset.alias(f"{tag}_at"), *rest)

    bits = ((1 << block_bits) + 2 * tolerance_micros).bit_length()
    pairs = bucketed_probe(
        placed(build, "m", "moment_id"), placed(blocked(q), "q", "query_id"), lambda table: XFastTries(table, bits), lambda tries, batch: _pair(tries, batch, tolerance_micros),
        "query_id string, moment_id bigint, distance bigint", slice_rows, F.monotonically_increasing_id(),
    )
    return pairs.groupBy("query_id", "moment_id").agg(F.min("distance").alias("distance"))


class XFastTries:
    """X-fast tries of several entities in one table of prefixes (vectorised, open addressing)."""

    def __init__(self, table: pa.Table, bits: int):
        tree, tree2, at, ident = (table.column(c).to_numpy() for c in ("m_tree", "m_tree2", "m_at", "moment_id"))
        order = np.lexsort((ident, at, tree2, tree))
        tree, tree2, at, ident = tree[order], tree2[order], at[order], ident[order]
        if len(at):
            new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (tree2[1:] != tree2[:-1]) | (at[1:] != at[:-1])))
            tree, tree2, at, ident = tree[new], tree2[new], at[new], ident[new]
        self.tree, self.tree2, self.at, self.ident, self.bits = tree, tree2, at, ident, bits
        n = len(at)
        nodes = {"tree": [], "tree2": [], "level": [], "prefix": [], "low": [], "high": []}
        for level in range(bits + 1) if n else ():
            prefix = at >> (bits - level)
            start = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (tree2[1:] != tree2[:-1]) | (prefix[1:] != prefix[:-1]))))
            nodes["tree"].append(tree[start])
            nodes["tree2"].append(tree2[start])
            nodes["level"].append(np.full(len(start), level, np.int64))
            nodes["prefix"].append(prefix[start])
            nodes["low"].append(start)
            nodes["high"].append(np.append(start[1:], n) - 1)
        self.node = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in nodes.items()}
        size = 1 << max(4, int(2 * len(self.node["low"])).bit_length())
        self.mask = np.uint64(size - 1)
        self.slot = np.full(size, -1, np.int64)
        todo = np.arange(len(self.node["low"]))
        at_slot = self._hash(self.node["tree"], self.node["level"], self.node["prefix"])
        while len(todo):
            here = at_slot[todo]
            free = self.slot[here] < 0
            self.slot[here[free]] = todo[free]  # of several that want a slot, one gets it
            lost = self.slot[here] != todo
            todo = todo[lost]
            at_slot[todo] = (at_slot[todo] + 1) & int(self.mask)

    def _hash(self, tree: np.ndarray, level: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = tree.astype(np.uint64) ^ (prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        return (x & self.mask).astype(np.int64)

    def _node(self, tree: np.ndarray, tree2: np.ndarray, level: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """The entry of each (tree, level, prefix), or -1."""
        out = np.full(len(tree), -1, np.int64)
        slot = self._hash(tree, level, prefix)
        todo = np.arange(len(tree))
        while len(todo):
            entry = self.slot[slot[todo]]
            todo, entry = todo[entry >= 0], entry[entry >= 0]
            n = self.node
            hit = (n["tree"][entry] == tree[todo]) & (n["prefix"][entry] == prefix[todo]) & (n["level"][entry] == level[todo]) & (n["tree2"][entry] == tree2[todo])
            out[todo[hit]] = entry[hit]
            todo = todo[~hit]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        return out

    def neighbours(self, tree: np.ndarray, tree2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers of the last moment at or before ``at`` and of the first at or after it; -1 for none."""
        bits, n = self.bits, len(tree)
        best = self._node(tree, tree2, np.zeros(n, np.int64), np.zeros(n, np.int64))
        low, high = np.zeros(n, np.int64), np.where(best >= 0, bits, 0)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            node = self._node(tree[open_], tree2[open_], mid, at[open_] >> (bits - mid))
            hit = node >= 0
            low[open_[hit]], best[open_[hit]] = mid[hit], node[hit]
            high[open_[~hit]] = mid[~hit] - 1
        before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        there = best >= 0
        leaf = there & (low == bits)
        before[leaf] = after[leaf] = self.node["low"][best[leaf]]
        inner = np.flatnonzero(there & ~leaf)
        up = ((at[inner] >> (bits - low[inner] - 1)) & 1).astype(bool)
        # The branch the query would take is missing: all leaves below lie on the other side of it.
        b = np.where(up, self.node["high"][best[inner]], self.node["low"][best[inner]] - 1)
        a = b + 1
        same = lambda leaf, q: (leaf >= 0) & (leaf < len(self.at)) & (self.tree[np.clip(leaf, 0, len(self.at) - 1)] == tree[q]) & (self.tree2[np.clip(leaf, 0, len(self.at) - 1)] == tree2[q])
        before[inner] = np.where(same(b, inner), b, -1)
        after[inner] = np.where(same(a, inner), a, -1)
        return before, after


def _pair(tries: XFastTries, batch: pa.RecordBatch, tolerance: int) -> pa.RecordBatch:
    tree, tree2, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    before, after = tries.neighbours(tree, tree2, at)
    far = np.iinfo(np.int64).max
    leaf_at = tries.at if len(tries.at) else np.zeros(1, np.int64)
    back = np.where(before >= 0, at - leaf_at[before], far)
    ahead = np.where(after >= 0, leaf_at[after] - at, far)
    distance = np.minimum(back, ahead)
    found = distance <= tolerance
    leaf = np.where(back <= ahead, before, after)[found]
    ident = (tries.ident if len(tries.ident) else np.zeros(1, np.int64))[leaf]
    return pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(found)), pa.array(ident), pa.array(distance[found])], ["query_id", "moment_id", "distance"])
