"""Sources: column-pruned Parquet and CSV scans, fallback chains, parameterised SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpanel.functions.keys import clean_ticker

#: Columns of a raw corpus and what they are called here.
RAW_COLUMNS = {"Date": "published_at", "Stock_symbol": "ticker", "Article_title": "title", "Publisher": "publisher", "Url": "url"}


def scan(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet files as one table. Projection and filter are left to the planner, which brings both to the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def load_raw(spark: SparkSession, paths: Sequence[str], tickers: Sequence[str] = (), names: Mapping[str, str] = RAW_COLUMNS) -> DataFrame:
    """Shards of a raw corpus: the needed columns only, renamed, tickers cleaned, kept when in ``tickers`` (empty: all)."""
    df = scan(spark, paths, list(names)).withColumnsRenamed(dict(names)).withColumn("ticker", clean_ticker("ticker"))
    return df.where(F.col("ticker").isin(*tickers)) if tickers else df


#: A price file's columns.
PRICE_CSV = T.StructType([T.StructField("Date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")]])


def csv_prices(spark: SparkSession, paths: Mapping[str, str], start: str, end: str) -> DataFrame:
    """Prices out of one CSV per ticker; a ticker whose file is missing is left out, ``adj_close`` is ``close``.

    All files missing is an error. The files are read by one scan, the ticker
    comes from the path.
    """
    there = {t: p for t, p in paths.items() if _exists(spark, p)}
    if not there:
        raise FileNotFoundError("no price file could be read")
    by_path = F.map_from_arrays(F.array(*[F.lit(p.rstrip("/").rpartition("/")[2]) for p in there.values()]), F.array(*[F.lit(t) for t in there]))
    part = F.input_file_name()
    name = F.when(F.try_element_at(by_path, F.element_at(F.split(part, "/"), -1)).isNotNull(), F.try_element_at(by_path, F.element_at(F.split(part, "/"), -1))).otherwise(F.try_element_at(by_path, F.element_at(F.split(part, "/"), -2)))
    raw = spark.read.csv(list(there.values()), header=True, schema=PRICE_CSV, mode="DROPMALFORMED")
    return raw.select(name.alias("ticker"), *[F.col(c).alias(c.lower()) for c in raw.columns], F.col("Close").alias("adj_close")).where(F.col("date").between(start, end)).select("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_source(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be planned and has a row; the last one whatever it has."""
    for make in sources[:-1]:
        try:
            df = make()
            if not df.isEmpty():
                return df
        except (AnalysisException, OSError):
            continue
    return sources[-1]()


def wide_to_long(wide: DataFrame, fields: Sequence[str], sep: str = "_") -> DataFrame:
    """``date`` and columns ``<field><sep><ticker>`` to one row per ticker and day, a column per field; bare fields mean one ticker, ''.

    One generate, no shuffle: each row becomes an array of structs by ticker.
    """
    tickers: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        for f in fields:
            if c == f or c.startswith(f + sep):
                tickers.setdefault(c[len(f) + len(sep):], {})[f] = c
    rows = [F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{cols[f]}`").cast("double") if f in cols else F.lit(None).cast("double")).alias(f) for f in fields]) for t, cols in sorted(tickers.items())]
    long = wide.select("date", F.explode(F.array(*rows)).alias("r")).select("r.ticker", "date", *[f"r.{f}" for f in fields])
    return long.where(F.greatest(*[F.col(f).isNotNull().cast("int") for f in fields], F.lit(0)) == 1) if len(fields) else long


def read_sql(spark: SparkSession, query: str, params: Mapping[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """SQL text with ``:name`` parameters over the frames given, named ``{name}`` in the text."""
    return spark.sql(query, args=dict(params or {}), **views)


def pick(df: DataFrame, allowed: Sequence[str], *columns: str) -> DataFrame:
    """A scan whose column is a parameter: only names in ``allowed`` are taken."""
    for c in columns:
        if c not in allowed:
            raise ValueError(f"unknown column {c!r}")
    return df.select(*columns)


def price_window(prices: DataFrame, start: str, end: str, warmup_days: int = 90, tail_days: int = 10) -> DataFrame:
    """Prices from ``warmup_days`` before ``start``, which windows need, to ``tail_days`` after ``end``, which labels need."""
    return prices.where(F.col("date").between(F.date_sub(F.lit(start).cast("date"), warmup_days), F.date_add(F.lit(end).cast("date"), tail_days)))
