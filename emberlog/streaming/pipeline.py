"""The monitoring loop: clean, score, upsert, alert, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog import fixed_values as fixed
from emberlog.operators import alerts, clean, documents
from emberlog.plans.detector import Model
from emberlog.session import slot_for, stage
from emberlog.sources.scan import with_time
from emberlog.sources.tables import write_batch

LAST_SENT = "severity string, second long, batch_id long"
TOP = 5


def _after_last_sent(due: DataFrame, table: str, batch_id: int, seconds: int) -> DataFrame:
    """Drop what falls into the cooldown of alerts that earlier batches sent."""
    spark = due.sparkSession
    if not documents.exists(spark, table):
        return due
    # One row per severity and batch, and only one batch is read: the partition
    # of the last one before this.
    kept = spark.read.schema(LAST_SENT).parquet(table).filter(F.col("batch_id") == batch_id - 1)
    for row in kept.collect():
        due = due.filter((F.col("severity") != row["severity"]) | (F.col("second") >= row["second"] + seconds))
    return due


def process_batch(
    sources: DataFrame, batch_id: int, model: Model, out: str, live: bool = False,
    cooldown_seconds: int = fixed.COOLDOWN_SECONDS, order: tuple[str, ...] = ("host", "log_file"),
) -> None:
    """One cycle. An empty batch does nothing; a repeated one changes nothing.

    Of rows with the same time and message the first in ``order`` is kept; it
    has to tell apart rows that a model scores differently.

    Writes under ``out``: ``scored`` and ``alerts`` (one partition per batch),
    ``documents`` (keyed, upserted), ``last_sent`` (per batch, five rows at
    most) and, on the live path, ``top`` (the batch's five highest scores).
    """
    slot = slot_for(out)
    logs = stage(with_time(clean.logs_from(sources, live, order)), "batch-logs", slot)
    if logs.isEmpty():
        _carry_over(logs.sparkSession, out, batch_id)
        return
    write_batch(model.predict(logs, slot), f"{out}/scored", batch_id)
    scored = logs.sparkSession.read.parquet(f"{out}/scored").filter(F.col("batch_id") == batch_id).drop("batch_id")
    docs = stage(documents.most_anomalous_per_key(documents.to_documents(scored)), "batch-documents", slot)
    documents.upsert(docs, f"{out}/documents", ready=True)
    if live:
        _put(top_view(docs), f"{out}/top", batch_id)
    due = _after_last_sent(alerts.candidates(alerts.actionable(docs)), f"{out}/last_sent", batch_id, cooldown_seconds)
    sent = alerts.alert_text(alerts.cooldown(due, seconds=cooldown_seconds))
    _put(sent.select("severity", "second", "doc_id", "text"), f"{out}/alerts", batch_id)
    _carry_over(logs.sparkSession, out, batch_id)


def top_view(docs: DataFrame, k: int = TOP) -> DataFrame:
    """What the live watcher shows of a cycle: its ``k`` highest scores, numbered."""
    first = docs.orderBy(F.col("anomaly_score_norm").desc(), "doc_id").limit(k)
    rank = F.row_number().over(W.orderBy(F.col("anomaly_score_norm").desc(), "doc_id"))  # of k rows
    return first.select(rank.alias("rank"), "doc_id", "timestamp", "severity", "anomaly_score_norm", "message_short")


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows in place of what the same batch wrote before."""
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def _carry_over(spark: SparkSession, out: str, batch_id: int) -> None:
    """The last alert per severity up to this batch: five rows at most, from two partitions."""
    found = []
    if documents.exists(spark, f"{out}/alerts"):
        found.append(spark.read.parquet(f"{out}/alerts").filter(F.col("batch_id") == batch_id).select("severity", "second"))
    if documents.exists(spark, f"{out}/last_sent"):
        kept = spark.read.schema(LAST_SENT).parquet(f"{out}/last_sent")
        found.append(kept.filter(F.col("batch_id") == batch_id - 1).select("severity", "second"))
    if found:
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        last = rows.groupBy("severity").agg(F.max("second").alias("second")).collect()
        if last:
            _put(spark.createDataFrame(last, "severity string, second long"), f"{out}/last_sent", batch_id)


def start_pipeline(
    sources: DataFrame, model: Model, out: str, checkpoint: str, live: bool = False,
    order: tuple[str, ...] = ("host", "log_file"), **trigger
) -> StreamingQuery:
    """Run ``process_batch`` over a stream of source documents.

    The default trigger is the scheduled cycle, or the live period when
    ``live``; pass e.g. ``availableNow=True`` to work off what is there.
    """
    default = {"processingTime": fixed.LIVE_PERIOD if live else f"{fixed.CYCLE_SECONDS} seconds"}
    run = lambda batch, batch_id: process_batch(batch, batch_id, model, out, live, order=order)
    writer = sources.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(trigger or default)).start()


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Stream of source documents from a folder; the cap bounds a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
