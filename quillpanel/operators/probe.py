"""A partitioned probe: sorted build rows per bucket, probe rows streamed against them.

Both sides go through one exchange on (bucket, slice). Within a partition the
build rows of a bucket sort before its probe rows, so a Python worker holds one
bucket's index and one Arrow batch at a time. Buckets with many probe rows are
cut into slices, each of which gets a copy of that bucket's build rows: a key
that holds a third of all probe rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets are numbered below this, which bounds the broadcast table of slices.
MAX_BUCKETS = 65_536


def bucket_count(build_rows: int, rows_per_bucket: int, at_least: int = 1) -> int:
    return max(1, at_least, min(MAX_BUCKETS, -(-build_rows // rows_per_bucket)))


def bucketed_probe(
    build: DataFrame,
    probe: DataFrame,
    make_index: Callable[[pa.Table], object],
    probe_index: Callable[[object, pa.RecordBatch], pa.RecordBatch],
    schema: str,
    slice_rows: int = 1_000_000,
    spread: Column | None = None,
) -> DataFrame:
    """Stream ``probe`` against an index made of each bucket's ``build`` rows.

    ``build`` and ``probe`` each have an int column ``bucket`` in [0, MAX_BUCKETS)
    and otherwise columns of their own with different names. ``make_index`` gets
    a bucket's build rows (perhaps none); ``probe_index`` gets it with a run of
    that bucket's probe rows and returns rows of ``schema``. An empty side is
    fine: no probe rows give no result rows.

    ``spread`` tells probe rows of a bucket apart for slicing; by default it is a
    hash of the row. It must give a row the same value when a lost task is run
    again: give a row number only over a scan.
    """
    build_fields = [f for f in build.schema.fields if f.name != "bucket"]
    probe_fields = [f for f in probe.schema.fields if f.name != "bucket"]
    none = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    own = lambda fields: [F.col(f.name) for f in fields]

    # At most MAX_BUCKETS rows of two ints: the broadcast is bounded whatever the data.
    slices = F.broadcast(
        probe.groupBy("bucket").agg(F.count("*").alias("n"))
        .where(F.col("n") > slice_rows)
        .select("bucket", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    )
    many = F.coalesce("slices", F.lit(1))
    b = build.join(slices, "bucket", "left").select(
        "bucket", F.explode(F.sequence(F.lit(0), many - 1)).alias("slice"), F.lit(0).alias("side"), *own(build_fields), *none(probe_fields)
    )
    p = probe.join(slices, "bucket", "left").select(
        "bucket", F.pmod(spread if spread is not None else F.xxhash64(*own(probe_fields)), many).cast("int").alias("slice"), F.lit(1).alias("side"), *none(build_fields), *own(probe_fields)
    )
    rows = b.unionByName(p).repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "side")
    b_names, p_names = [f.name for f in build_fields], [f.name for f in probe_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, side = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            tag = (bucket << 32) | (part << 1) | side
            cuts = np.concatenate(([0], np.flatnonzero(tag[1:] != tag[:-1]) + 1, [len(tag)]))
            builds, probes = batch.select(b_names), batch.select(p_names)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                here = int(tag[lo]) >> 1
                if here != at:
                    at, held, index = here, [], None
                if not tag[lo] & 1:
                    held.append(builds.slice(lo, hi - lo))
                    continue
                if index is None:
                    index = make_index(pa.Table.from_batches(held, schema=builds.schema))
                    held = []
                yield probe_index(index, probes.slice(lo, hi - lo))

    return rows.mapInArrow(run, T._parse_datatype_string(schema))
