"""Session settings and the shared working folder."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# UTC because hour-of-day and weekday features are defined in UTC; AQE for
# runtime coalescing, broadcast demotion and skew splitting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("emberlog")
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Small single-file tables are dealt to all cores.
        "spark.emberlog.spread": str(os.cpu_count() if cores == "*" else cores),
        "spark.driver.memory": "12g",
        # One task, one core: numpy inside tasks must not start its own threads.
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """One of the session's settings for the length of a block."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session that names none gets a folder of its own; on a
    cluster a folder of the driver's machine would be of no use.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master!r} share")
        path = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a scan to so many partitions, where the caller asks for it.

    Meant for tables of one small file; large tables have partitions enough,
    and moving them would cost a shuffle.
    """
    return scan.repartition(partitions) if partitions else scan


def slot_for(path: str) -> str:
    """Name of the staging place that work on ``path`` uses over and over."""
    return hashlib.md5(path.encode()).hexdigest()[:12]


def scratch(spark: SparkSession, name: str, slot: str | None = None) -> str:
    """A place of its own under the shared folder, or the one of ``slot``."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/emberlog/{app}/{name}-{slot or uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, slot: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is read more than once. The table outlives any
    executor, so a lost node costs a re-read and not a recomputation. Work that
    repeats, such as a stream's batches, names a ``slot``: its next table takes
    the place of the last one, so that staged data does not pile up. ``by``
    keeps the table in one folder per value of that column.
    """
    path = scratch(df.sparkSession, name, slot)
    writer = (gathered(df, by) if by else df).write.mode("overwrite" if slot else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, by: str) -> DataFrame:
    """Rows of one folder in one task, or a few where it is large.

    Otherwise each task writes a file into each folder, and a table over more
    days and with more tasks has files by the product of both.
    """
    return df.hint("rebalance", by)


def clear(spark: SparkSession) -> None:
    """Remove what this application has staged. Tables read from there are gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/emberlog/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
