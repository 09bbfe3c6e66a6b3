"""Headlines scored as they arrive: a file stream into the store, one upsert per micro-batch.

Beyond what the batch pipeline needs: attribution and scoring have no state, so
a micro-batch is the batch plan over its rows. Windowed features stay a batch
job, as row-frame windows are not defined on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillpanel.config import SETTINGS
from quillpanel.operators import headlines as HL
from quillpanel.operators import scoring
from quillpanel.sources.schema import KEYS
from quillpanel.sources.writers import Store


def stream_headlines(
    spark: SparkSession, source: str, store: Store, checkpoint: str, make: Callable[[], scoring.Scorer] = scoring.LexiconScorer,
    model: str = SETTINGS.model, lag: int = SETTINGS.extra_lag_sessions,
) -> StreamingQuery:
    """Takes what lies in ``source`` (Parquet with ticker, published_at, title, publisher, url) and stops when it is through.

    Repeating a micro-batch after a failure changes nothing: rows are upserted
    by their content hash.
    """
    rows = spark.readStream.schema("ticker string, published_at timestamp_ntz, title string, publisher string, url string").parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        new = HL.ingest(df, store.read("prices"), lag).persist()
        try:
            store.upsert("headlines", new, KEYS["headlines"])
            store.upsert("sentiment", scoring.score(HL.unscored(new, store.read("sentiment"), model), model, make), KEYS["sentiment"])
        finally:
            new.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_hour(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """``(start, ticker, n)``: headlines per ticker and hour of publication, with a watermark for late ones."""
    timed = stream.withColumn("at", F.col("published_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "ticker").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "ticker", "n")
