"""Anomaly documents: projection, keys, keyed upsert."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import severity, text, times
from emberlog.operators.scoring import anomalies
from emberlog.schemas import ANOMALY_DOC, require_columns
from emberlog.session import slot_for, stage
from emberlog.sources import snapshots

RENAMED = {"error_flag": "contains_error", "login_flag": "contains_login", "warning_flag": "contains_warning"}


def _parsed(scored: DataFrame) -> DataFrame:
    """Anomalies with their time as ``_ts``; null where it is not a time."""
    require_columns(scored, "anomaly", "message")
    source = "@timestamp" if "@timestamp" in scored.columns else "timestamp"
    return anomalies(scored).withColumn("_ts", times.parse(text.strip(F.col(source))))


def rejected(scored: DataFrame) -> DataFrame:
    """Anomalies that cannot be keyed because their time does not parse."""
    return _parsed(scored).filter("_ts IS NULL").drop("_ts")


def tally(scored: DataFrame) -> DataFrame:
    return _parsed(scored).agg(
        F.count_if(F.col("_ts").isNotNull()).alias("uploaded"),
        F.count_if(F.col("_ts").isNull()).alias("skipped"),
    )


def _field(name: str, df: DataFrame) -> Column:
    """A document field: renamed, cast, and defaulted where absent or null."""
    source = RENAMED.get(name, name)
    kind = ANOMALY_DOC[name].dataType
    default = {"string": F.lit("INFO") if name == "severity" else F.lit("")}.get(kind.simpleString(), F.lit(0))
    value = F.coalesce(F.col(source), default) if source in df.columns else default
    return value.cast(kind).alias(name)


def to_documents(scored: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """One document per anomaly whose time parses; several may share a key.

    ``key_cols`` (e.g. the host) widen the key.
    """
    rows = _parsed(scored).filter("_ts IS NOT NULL")
    rows = rows.withColumn("_iso", times.iso_utc(F.col("_ts"))).withColumn("message", F.coalesce("message", F.lit("")))
    iso, message = F.col("_iso"), F.col("message")
    fixed_fields = {
        "doc_id": severity.document_id(iso, message, *[F.col(c) for c in key_cols]).alias("doc_id"),
        "timestamp": iso.alias("timestamp"),
        "message_short": text.shorten(message, 200).alias("message_short"),
    }
    return rows.select(*[fixed_fields.get(f.name, _field(f.name, rows)) for f in ANOMALY_DOC])


def to_alert_rows(scored: DataFrame, now: str) -> DataFrame:
    """The older alert path: one alert for every row, labelled or not, all on the clock ``now``."""
    flags = [F.coalesce(c, F.lit(0)) for c in ("contains_error", "contains_login", "contains_warning")]
    level = severity.from_raw(F.col("anomaly_score"), *flags)
    clock = times.iso_utc(F.lit(now).cast("timestamp"))
    message = F.coalesce("message", F.lit(""))
    return scored.select(
        severity.document_id(clock, message).alias("alert_id"), clock.alias("timestamp"), message.alias("message"),
        "anomaly_score", level.alias("severity"))


def to_legacy_documents(scored: DataFrame) -> DataFrame:
    """The older ten-field document, with severity from the raw score and flags."""
    docs = to_documents(scored)
    level = severity.from_raw(*[F.col(c) for c in ("anomaly_score", "error_flag", "login_flag", "warning_flag")])
    return docs.select(
        "doc_id", "timestamp", "message", "msg_length", "error_flag", "login_flag", "warning_flag",
        "digit_count", "anomaly", "anomaly_score", level.alias("severity"),
    )


def most_anomalous_per_key(docs: DataFrame) -> DataFrame:
    """One document per key: the lowest raw score, then the earliest time."""
    return _first_per_key(docs, F.col("anomaly_score"), F.col("timestamp"))


def last_per_key(docs: DataFrame, written: str) -> DataFrame:
    """One document per key: the last one written, by the order column ``written``."""
    return _first_per_key(docs, F.col(written).desc(), F.col("anomaly_score"), F.col("timestamp"))


def _first_per_key(docs: DataFrame, *order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return docs.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing documents with the new ones in place of those they match."""
    return existing.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def upsert(new: DataFrame, path: str, written: str | None = None, ready: bool = False) -> DataFrame:
    """Merge documents into the table at ``path``, kept by day in snapshots.

    A batch replaces what is there. If it has several documents of one key, the
    last one by the order column ``written`` wins, or without such a column the
    most anomalous one. The key ``doc_id`` contains the time, so a document can
    only replace one of its own day: just the days in the batch are read and
    written anew. All of them change with one commit, so that a driver lost at
    any moment leaves the old table or the new one. Repeating an upsert changes
    nothing. ``read`` gives the table. A batch that is ``ready`` has one
    document per key and is kept somewhere already.
    """
    spark, day = new.sparkSession, F.substring("timestamp", 1, 10)
    if ready:
        batch = new.withColumn("day", day)
    else:
        batch = (last_per_key(new, written) if written else most_anomalous_per_key(new)).withColumn("day", day)
        batch = stage(batch, "upsert-batch", slot_for(path))
    days = snapshots.days_of(batch)
    if days:
        held = snapshots.read(spark, path, batch.schema, days)
        snapshots.write_days(merge(held.select(*batch.columns), batch), path, days)
    return snapshots.read(spark, path, batch.schema)


def read(spark: SparkSession, path: str, schema=ANOMALY_DOC) -> DataFrame:
    """The documents at ``path`` with their ``day``; none where there is no table."""
    return snapshots.read(spark, path, schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; any other failure to read it is raised."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
