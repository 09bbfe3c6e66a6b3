"""Sinks and mutations on Parquet: every write makes a new part and then switches a pointer to it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpanel.sources.schema import schema


class Store:
    """Tables below ``root``. A table is a folder of parts and a pointer file naming the current ones.

    A part is written whole before the pointer is replaced by a rename, so a
    reader sees the old table or the new one, and a job that is lost leaves the
    old one. Parts that no pointer names any more go with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._written: dict[str, T.StructType] = {}  # schemas of the parts written here, which are never changed

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self, path: str) -> str | None:
        p, fs = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """A small file, there whole or not at all: written beside its place and renamed over what is there."""
        sc = self.spark.sparkContext
        beside = f"{path}.{uuid.uuid4().hex}"
        new, fs = self._fs(beside)
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = sc._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        source = fs.makeQualified(new)
        context = hadoop.FileContext.getFileContext(source.toUri(), sc._jsc.hadoopConfiguration())
        context.rename(source, fs.makeQualified(hadoop.Path(path)), how)

    def _parts(self, table: str) -> list[str] | None:
        held = self._load(f"{self.root}/{table}/_current.json")
        return None if held is None else json.loads(held)["parts"]

    def _switch(self, table: str, parts: Sequence[str]) -> None:
        self._put(f"{self.root}/{table}/_current.json", json.dumps({"parts": list(parts)}))

    def exists(self, table: str) -> bool:
        return self._parts(table) is not None

    def read(self, table: str) -> DataFrame:
        parts = self._parts(table)
        if parts is None:
            raise FileNotFoundError(table)
        known = {self._written[part].simpleString() if part in self._written else None for part in parts}
        reader = self.spark.read if None in known or len(known) > 1 else self.spark.read.schema(self._written[parts[0]])
        return reader.parquet(*[f"{self.root}/{table}/{part}" for part in parts])

    def write(self, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Truncate and load."""
        part = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{part}")
        if not partition_by:
            self._written[part] = df.schema
        self._switch(table, [part])
        return self.read(table)

    def put_json(self, name: str, value: object) -> None:
        self._put(f"{self.root}/{name}.json", json.dumps(value))

    def get_json(self, name: str) -> object | None:
        held = self._load(f"{self.root}/{name}.json")
        return None if held is None else json.loads(held)

    def vacuum(self, table: str, older_than_hours: float = 24.0) -> int:
        """Remove parts that are not current and have lain for so long that no reader is on them; returns how many."""
        current, gone = set(self._parts(table) or ()), 0
        folder, fs = self._fs(f"{self.root}/{table}")
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            name = status.getPath().getName()
            if status.isDirectory() and name not in current and status.getModificationTime() <= (time.time() - 3600 * older_than_hours) * 1000:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def create(self, table: str, drop: bool = False, fields: T.StructType | None = None) -> DataFrame:
        """An empty table where there is none; with ``drop`` also where there is one."""
        if drop and self.exists(table):
            p, fs = self._fs(f"{self.root}/{table}")
            fs.delete(p, True)
        if not self.exists(table):
            self.write(table, self.spark.createDataFrame([], fields or schema(table)))
        return self.read(table)

    def upsert(self, table: str, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
        return self.write(table, upserted(self.read(table), rows, key, order))

    def replace_keys(self, table: str, rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
        return self.write(table, replaced(self.read(table), rows, key, values))

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows as one more part; what is there is not written again."""
        parts = self._parts(table)
        if parts is None:
            return self.write(table, rows)
        part = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{table}/{part}")
        self._written[part] = rows.schema
        self._switch(table, [*parts, part])
        return self.read(table)


def upserted(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """``target`` with ``rows`` inserted or, where the key is there, updated in the columns that ``rows`` has.

    - Other columns keep their value, or are null in a new row. Columns that
      ``target`` lacks are left out. NaN becomes null.
    - Of several rows with a key the last by ``order`` counts (by all columns where none is given).
    - A key with a null matches no other, as in SQL.
    """
    own = [c for c in rows.columns if c in target.columns]
    rest = [c for c in own if c not in key]
    floats = {f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in own]
    rank = order if order is not None else F.struct(*[F.col(c) for c in own])
    newest = rows.select(*clean, rank.alias("_order")).groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rest], F.lit(True).alias("_new")), "_order").alias("_row"))
    both = target.alias("t").join(newest.alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "full")
    return both.select(*[
        F.coalesce(f"t.{c}", f"s.{c}").alias(c) if c in key
        else F.when(F.col("s._row._new"), F.col(f"s._row.{c}")).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in rest
        else F.col(f"t.{c}")
        for c in target.columns
    ])


def replaced(target: DataFrame, rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``target`` without the rows of the key values named, plus ``rows``; a value that has no new rows loses its old ones too."""
    return target.where(~F.coalesce(F.col(key).isin(list(values)), F.lit(False))).unionByName(rows.select(*target.columns))


def numbered(rows: DataFrame, log: DataFrame, order: Sequence[str], ident: str = "id") -> DataFrame:
    """``rows`` with ids that go on from those of ``log``. For the few rows of one append."""
    last = log.agg(F.coalesce(F.max(ident), F.lit(0))).scalar()
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.withColumn(ident, (last + n).cast("long"))


def backfilled(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Outcomes written into predictions whose ``realized_up`` is null, from the feature row of the ticker and day; unmatched ones stay null."""
    f = features.select("ticker", "date", F.col("fwd_ret_1d").alias("_ret"), F.col("target_next_up").alias("_up"))
    open_ = F.col("realized_up").isNull()
    return predictions.join(f, ["ticker", "date"], "left").withColumns({
        "realized_ret": F.when(open_, F.col("_ret")).otherwise(F.col("realized_ret")),
        "realized_up": F.when(open_, F.col("_up")).otherwise(F.col("realized_up")),
    }).select(*predictions.columns)
