"""Alert cooldown as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberlog import fixed_values as fixed
from emberlog.session import setting

OUTPUT = "severity string, second long, doc_id string, timestamp string, message string, anomaly_score_norm double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(gap: int) -> StatefulProcessor:
    class Cooldown(StatefulProcessor):
        """Remembers, per severity, the second of the last alert sent."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._last = handle.getValueState("last", "second long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # At most one row per second and severity gets here. The seconds are
            # put in order and only those sent are stepped through; the rows
            # themselves stay in their frames.
            frames = list(rows)
            seconds = np.concatenate([pdf["second"].to_numpy(np.int64) for pdf in frames])
            order = np.argsort(seconds, kind="stable")
            seconds = seconds[order]
            at = np.searchsorted(seconds, self._last.get()[0] + gap) if self._last.exists() else 0
            sent = []
            while at < len(seconds):
                sent.append(at)
                at = max(np.searchsorted(seconds, seconds[at] + gap), at + 1)
            if sent:
                self._last.update((int(seconds[sent[-1]]),))
            picked, start = np.sort(order[sent]), 0
            for pdf in frames:
                mine = picked[(picked >= start) & (picked < start + len(pdf))] - start
                start += len(pdf)
                if len(mine):
                    yield pdf.iloc[mine]

        def close(self) -> None:
            pass

    return Cooldown()


def stream_cooldown(docs: DataFrame, delay: str = "1 minute", seconds: int = fixed.COOLDOWN_SECONDS) -> DataFrame:
    """Alerts due from a stream of anomaly documents with a ``ts`` column.

    One-second windows keep the best document per severity and second, with
    partial aggregation; only those reach the few stateful keys, however many
    documents share a severity.
    """
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    payload = F.struct("doc_id", "timestamp", "message", "anomaly_score_norm")
    first = F.struct(-F.col("anomaly_score_norm"), F.col("doc_id"))
    best = (
        docs.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 second").alias("w"), "severity")
        .agg(F.min_by(payload, first).alias("d"))
        .select("severity", F.unix_timestamp("w.start").alias("second"), "d.*")
    )
    return best.groupBy("severity").transformWithStateInPandas(
        statefulProcessor=_processor(seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def start_cooldown(
    docs: DataFrame, path: str, checkpoint: str, delay: str = "1 minute", seconds: int = fixed.COOLDOWN_SECONDS, **trigger
) -> StreamingQuery:
    """Write the alerts due from a stream to ``path``.

    Every partition of state is opened and kept anew by each batch, whatever is
    in it, at some tenths of a second. So the stream has as many as tasks run
    at once, and not as many as a large shuffle. A checkpoint keeps its number.
    """
    spark = docs.sparkSession
    tasks = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A query takes the session's settings along when it starts.
    with setting(spark, "spark.sql.shuffle.partitions", str(tasks)):
        writer = stream_cooldown(docs, delay, seconds).writeStream.outputMode("append").format("parquet")
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
