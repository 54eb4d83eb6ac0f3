"""Incremental maintenance as a stream. The batch operators define the result; the stream feeds them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources import tables


def latest_by_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, in a batch or in a stream (in update or complete mode)."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(key, "row.*")


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by window and type; in a stream, rows later than ``late`` are dropped once their window is closed."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), by, "n", "total")
    )


def upsert_stream(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, key: str = "id", order: list[str] | None = None, buckets: int = 64):
    """Start a query that keeps a keyed table of the greatest row of each key by ``order``, across batches: a late row of less order changes nothing.

    Each batch is a merge of its number, which rewrites only the buckets of its keys; a batch that is run again finds its merge in the log.
    """
    try:
        table = tables.opened(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = tables.created(spark, path, source.schema, key, tuple(order or ()), buckets)

    def put(batch: DataFrame, number: int) -> None:
        tables.merge(spark, table, batch, number)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
