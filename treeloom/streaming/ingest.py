"""An extension: streams of builds and of work items. What the engine is modelled on has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str):
    """Ingest build documents (JSON text files, one per build) as they arrive; a build that is unchanged is skipped.

    A batch is one ingest: all of its builds become visible at once. It may be replayed after a failure, as builds
    whose hash is stored are skipped.
    """
    stream = spark.readStream.text(folder, wholetext=True).select(F.col("value").alias("doc"))

    def batch(df: DataFrame, _: int) -> None:
        store.ingest_many(df)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(items: DataFrame, status: str = "status", when: str = "at", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Work items by status and time window; works on streams and on tables."""
    rows = items.withWatermark(when, late) if items.isStreaming else items
    return rows.groupBy(F.window(when, window).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), status, "n")
