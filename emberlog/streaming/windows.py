"""Windowed counts over log streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog import fixed_values as fixed
from emberlog.sources.scan import with_time


def with_late_bound(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows may arrive up to ``delay`` behind the latest time seen.

    A delay of zero is a plain high-water mark: what is older is not read.
    """
    return with_time(stream).withWatermark("ts", delay)


def drop_repeats(stream: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("@timestamp", "message")) -> DataFrame:
    """Drop rows seen before, also in an earlier batch, within ``delay``."""
    return with_late_bound(stream, delay).dropDuplicatesWithinWatermark(list(keys))


def _count(rows: DataFrame, window: Column, name: str) -> DataFrame:
    """Rows per window. Grouped by the window itself: its start alone would
    not carry the late bound, and state would never be dropped."""
    return rows.groupBy(window.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias(name), "n")


def tumbling_counts(stream: DataFrame, delay: str = "10 minutes", window: str = fixed.CYCLE) -> DataFrame:
    return _count(with_late_bound(stream, delay), F.window("ts", window), "cycle")


def live_panes(stream: DataFrame, delay: str = "10 minutes", slide: str = fixed.LIVE_PERIOD) -> DataFrame:
    """Counts per 15 seconds, what the live view is made of.

    The view's windows overlap twenty times. The stream keeps each row in one
    pane only; ``security.windows_of_panes`` adds up panes where they are read.
    """
    return _count(with_late_bound(stream, delay), F.window("ts", slide), "pane")


def write_changes(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the windows each batch changed, in a partition of that batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        )

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{fixed.CYCLE_SECONDS} seconds"})).foreachBatch(save).start()


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The current count per window: the one its last batch wrote."""
    return changes.groupBy(key).agg(F.max_by("n", "batch_id").alias("n"))
