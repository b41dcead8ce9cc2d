"""Readers and writers of the package's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import schemas
from emberlog.operators.scoring import anomalies
from emberlog.session import gathered


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table with a fixed schema; nothing is inferred, so no extra pass."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Quoted messages may hold line breaks. A field that is not there is null,
        # a quoted one without content is empty: hence a mark that no text is.
        reader = reader.options(header=True, multiLine=True, escape='"', nullValue="\x00")
    return reader.format(fmt).load(path)


def read_sources(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read(spark, path, schemas.SOURCE, fmt)


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.LOG, fmt)


def read_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.SCORED, fmt)


def write_logs(logs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the log table. With a ``ts`` column it is kept by day."""
    by_day = "ts" in logs.columns
    rows = gathered(logs.withColumn("day", F.to_date("ts")), "day") if by_day else logs
    writer = rows.write.mode("overwrite")
    if by_day:
        writer = writer.partitionBy("day")
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.format(fmt).save(path)


def write_batch(scored: DataFrame, path: str, batch_id: int) -> None:
    """Add one batch of scored rows, in its own partition.

    A repeated batch replaces its partition and nothing else, so earlier
    batches stay readable and a retry does no harm.
    """
    (
        scored.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def write_anomalies(scored: DataFrame, path: str) -> None:
    """The anomalous rows alone."""
    anomalies(scored).write.mode("overwrite").parquet(path)
