"""Per-key results when a few keys hold most of the rows.

Two-stage salted aggregation. A first pass counts rows per key (map-side
combined) and names the heavy keys: those with more than a fixed share of all
rows, so there are at most ``1 / share`` of them however many keys exist. Rows
of a heavy key are spread over salts, partial results are made per (key, salt),
and the partials are merged by key.

For exact distinct counts the salt is drawn from the hash of the value counted,
which is as good as random over rows but puts equal values of a key under one
salt, so that the distinct counts of the salts add up; and it comes out the same
when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.functions.keys import hash128


def heavy_keys(rows: DataFrame, key: Column, share: float = 1 / 256, salt_share: float = 1 / 1024) -> DataFrame:
    """``(heavy_key, salts)`` for keys with more than ``share`` of the rows: under ``1 / share`` rows in all.

    A heavy key gets one salt per ``salt_share`` of all rows.
    """
    total = rows.count()
    counts = rows.select(key.alias("heavy_key")).groupBy("heavy_key").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > share * total).select("heavy_key", F.ceil(F.col("n") / max(1.0, salt_share * total)).cast("int").alias("salts"))


def salted_summary(rows: DataFrame, key: Column, moment: Column, distinct: Mapping[str, Column], share: float = 1 / 256) -> DataFrame:
    """Per key: ``n`` distinct rows, first and last ``moment``, and of each column in ``distinct`` the number of values.

    - Repeated rows (equal in every column, the key as ``key`` gives it) count once.
    - Nulls are no value for ``distinct``; a null key is a key of its own; a key
      without any moment has null first and last.
    - No rows give no result.

    Values travel as 128-bit hashes, never as text. Stage one groups by
    (key, kind, salt, value); a value repeated without end is combined before
    the exchange. Stage two merges the values of a (key, salt), stage three the
    salts of a key.
    """
    heavy = F.broadcast(heavy_keys(rows, key, share))  # under 1 / share rows
    w1, w2 = hash128(key, *[F.col(f"`{c}`") for c in rows.columns])
    kinds = [F.struct(F.lit("").alias("kind"), w1.alias("v1"), w2.alias("v2"))]
    for name, value in distinct.items():
        v1, v2 = hash128(value)
        kinds.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("kind"), v1.alias("v1"), v2.alias("v2"))))
    values = rows.select(key.alias("key"), moment.alias("moment"), F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("k")).select("key", "k.*", F.when(F.col("k.kind") == "", F.col("moment")).alias("moment"))
    salted = values.join(heavy, F.col("key").eqNullSafe(F.col("heavy_key")), "left").select(
        "key", "kind", "v1", "v2", "moment", F.pmod(F.xxhash64("v1", "v2"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    )
    stage1 = salted.groupBy("key", "kind", "salt", "v1", "v2").agg(F.min("moment").alias("first"), F.max("moment").alias("last"))
    stage2 = stage1.groupBy("key", "kind", "salt").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    only = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return stage2.groupBy("key").agg(only("").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), *[only(k).alias(k) for k in distinct])
