"""Tables kept by day whose content changes as a whole or not at all.

A change writes the days it touches into a folder of its own and then commits a
snapshot, a small file that names the folder of every day. The commit is one
rename. A driver or an executor that is lost before it leaves the last snapshot
as it was, and folders that no snapshot names; one that is lost after it has
done its work. Readers of an older snapshot go on undisturbed until ``vacuum``.
One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.session import gathered

LISTS, PARTS = "_snapshots", "parts"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots there are, ascending."""
    where, files = _files(spark, f"{path}/{LISTS}")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def folders(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """Day and folder name of a snapshot, the latest by default; one entry per day."""
    there = numbers(spark, path)
    if not there:
        return {}
    where, files = _files(spark, f"{path}/{LISTS}/{there[-1] if number is None else number}.json")
    stream = files.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, schema: T.StructType | str, days: list[str] | None = None,
         number: int | None = None) -> DataFrame:
    """The rows of a snapshot, with their ``day``; of some days only where asked. Empty where there is no table."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    schema = T.StructType([f for f in schema if f.name != "day"] + [T.StructField("day", T.StringType())])
    held = folders(spark, path, number)
    paths = [f"{path}/{PARTS}/{held[d]}/day={d}" for d in (held if days is None else days) if d in held]
    if not paths:
        return spark.createDataFrame([], schema)
    # The folder's own name is a column as well, which the schema leaves out.
    rows = spark.read.option("basePath", f"{path}/{PARTS}").schema(schema).parquet(*paths)
    return rows.select(*schema.names)


def write_days(rows: DataFrame, path: str, days: list[str]) -> int:
    """Put ``rows``, which have a ``day``, in place of the given days; the new snapshot's number.

    ``rows`` may read the table itself, as nothing there is overwritten.
    """
    spark, folder = rows.sparkSession, f"change={uuid.uuid4().hex}"
    gathered(rows, "day").write.mode("errorifexists").partitionBy("day").parquet(f"{path}/{PARTS}/{folder}")
    return commit(spark, path, folders(spark, path) | {d: folder for d in days})


def commit(spark: SparkSession, path: str, held: dict[str, str]) -> int:
    """Make ``held`` the content of the table: write the list aside, then rename it."""
    number = max(numbers(spark, path), default=-1) + 1
    draft, files = _files(spark, f"{path}/{LISTS}/.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    finally:
        out.close()
    done, _ = _files(spark, f"{path}/{LISTS}/{number}.json")
    if files.exists(done) or not files.rename(draft, done):
        raise RuntimeError(f"snapshot {number} of {path} is there already: another writer was faster")
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all snapshots but the newest ``keep`` and the folders that none of those names; how many folders went."""
    there = numbers(spark, path)
    wanted = {f for n in there[-keep:] for f in folders(spark, path, n).values()}
    for n in there[:-keep]:
        where, files = _files(spark, f"{path}/{LISTS}/{n}.json")
        files.delete(where, False)
    root, files = _files(spark, f"{path}/{PARTS}")
    gone = [s.getPath() for s in files.listStatus(root) if s.getPath().getName() not in wanted] if files.exists(root) else []
    for where in gone:
        files.delete(where, True)
    return len(gone)


def days_of(rows: DataFrame) -> list[str]:
    """The days ``rows`` has; a batch has a few, a table thousands at most."""
    return sorted(r["day"] for r in rows.select(F.col("day").cast("string").alias("day")).distinct().collect())
