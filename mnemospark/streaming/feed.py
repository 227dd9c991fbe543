"""Change feeds and event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import BucketedTable, reduce_changes


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def apply_feed(feed: DataFrame, table: BucketedTable, checkpoint: str, entry: str = "id", action: str = "action", value: str = "new_value", order: Sequence = ("timestamp",), once: bool = True) -> StreamingQuery:
    """Merge a stream of changes into a table, batch by batch.

    A change may come again or late, in any batch: merging is idempotent and doesn't depend on the order of arrival, so a
    batch that is run again after a failure does no harm.
    """

    def merge(batch: DataFrame, _: int) -> None:
        columns = [F.col(c) if isinstance(c, str) else c for c in order]
        table.apply(reduce_changes(batch, table.keys, entry, action, value, columns))

    writer = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, time: str, width: str, keys: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events per window, tumbling or sliding, later ones than ``late`` left out: (start, end, keys, n). Batch or stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, parted by pauses of ``gap``: (key, start, end, n). Batch or stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_by_id(events: DataFrame, time: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Each id once, remembered for ``late``."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
