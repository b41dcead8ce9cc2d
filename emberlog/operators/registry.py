"""Model versions: acceptance, retention, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators.documents import exists
from emberlog.session import stage

REGISTRY = "tag string, path string, ok boolean, rate double, reason string"
POINTER = "seq long, action string, tag string"


def gate_columns(total: Column, anomalies: Column, low: float, high: float) -> dict[str, Column]:
    rate = F.coalesce(F.try_divide(anomalies, total), F.lit(0.0))
    reason = (
        F.when(total == 0, "no rows")
        .when(rate < low, F.format_string("rate %.4f under %s", rate, F.lit(str(low))))
        .when(rate > high, F.format_string("rate %.4f over %s", rate, F.lit(str(high))))
        .otherwise(F.format_string("rate %.4f (%d of %d)", rate, anomalies, total))
    )
    return {"ok": (total > 0) & rate.between(low, high), "rate": rate, "reason": reason}


def validation_gate(
    scored: DataFrame, low: float = fixed.GATE_LOW, high: float = fixed.GATE_HIGH, size: str | None = None
) -> DataFrame:
    """Is the anomaly rate within bounds, both included? One row, one pass. ``size`` says how many rows one stands for."""
    n, hit = F.col(size) if size else F.lit(1), F.col("anomaly") == -1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = scored.agg(total(n).alias("total"), total(F.when(hit, n)).alias("anomalies"))
    return one.select(*[c.alias(n) for n, c in gate_columns(F.col("total"), F.col("anomalies"), low, high).items()])


def retain_newest(registry: DataFrame, n: int = fixed.KEEP_VERSIONS) -> DataFrame:
    """The ``n`` newest versions by tag."""
    return registry.orderBy(F.col("tag").desc()).limit(n)


def retain_published(registry: DataFrame, n: int = fixed.KEEP_VERSIONS) -> DataFrame:
    """The ``n`` newest versions, and the newest accepted one even if it is older."""
    return retain_newest(registry, n).unionByName(select_version(registry)).distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All versions, of one tag the entry made last; empty where there is no registry yet."""
    if not exists(spark, f"{path}/versions"):
        return spark.createDataFrame([], REGISTRY)
    rows = spark.read.schema(f"{REGISTRY}, entry long").parquet(f"{path}/versions")
    return rows.groupBy("tag").agg(F.max_by(F.struct("path", "ok", "rate", "reason"), "entry").alias("v")).select("tag", "v.*")


def pointer(spark: SparkSession, path: str) -> DataFrame:
    """What was in use one after the other: ``seq, action, tag``, the last row being in use now."""
    if not exists(spark, f"{path}/pointer"):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(f"{path}/pointer")


def _count(rows: DataFrame, column: str) -> int:
    return rows.agg(F.coalesce(F.max(column), F.lit(-1))).first()[0] + 1


def publish(entries: DataFrame, path: str) -> None:
    """Enter versions with their verdicts; the accepted ones come into use one after the other by tag.

    Registry and pointer are only ever appended to, so that a driver lost on
    the way leaves what was there. The versions are entered first: a version
    without a pointer row is not in use, and publishing it again puts that right.
    """
    spark = entries.sparkSession
    known = exists(spark, f"{path}/versions")
    entry = _count(spark.read.schema(f"{REGISTRY}, entry long").parquet(f"{path}/versions"), "entry") if known else 0
    entries = stage(entries.select("tag", "path", "ok", "rate", "reason"), "registry-entries")
    entries.withColumn("entry", F.lit(entry).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    _point(entries.filter("ok").select("tag"), path, "publish")


def _point(tags: DataFrame, path: str, action: str) -> None:
    spark = tags.sparkSession
    first = _count(pointer(spark, path), "seq")
    rank = F.row_number().over(W.orderBy("tag"))  # of the versions published at once
    rows = tags.select((rank - 1 + first).cast("long").alias("seq"), F.lit(action).alias("action"), "tag")
    if not rows.isEmpty():
        rows.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version in use, one row, or none."""
    last = pointer(spark, path).orderBy(F.col("seq").desc()).limit(1)
    return read(spark, path).join(last.select("tag"), "tag", "left_semi")


def rollback(spark: SparkSession, path: str, tag: str | None = None) -> str:
    """Take an earlier accepted version into use, and keep it in use until the next is published.

    Without a tag it is the newest accepted one older than that in use.
    """
    accepted = read(spark, path).filter("ok")
    if tag is None:
        now = current(spark, path).select("tag").first()
        accepted = accepted.filter(F.col("tag") < now["tag"]) if now else accepted.limit(0)
    chosen = select_version(accepted, tag).select("tag").first()
    if chosen is None:
        raise LookupError("no accepted model version to go back to")
    _point(spark.createDataFrame([chosen], "tag string"), path, "rollback")
    return chosen["tag"]


def versions(registry: DataFrame) -> DataFrame:
    """All versions, the newest accepted one marked."""
    newest = registry.filter("ok").agg(F.max("tag")).scalar()
    return registry.withColumn("latest", F.coalesce(F.col("tag") == newest, F.lit(False)))


def select_version(registry: DataFrame, tag: str | None = None) -> DataFrame:
    """The accepted version to roll back to: the given tag, else the newest."""
    rows = registry.filter("ok")
    return rows.filter(F.col("tag") == tag) if tag else rows.orderBy(F.col("tag").desc()).limit(1)
