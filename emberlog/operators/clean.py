"""From nested source documents to the flat, de-duplicated log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import text

SOURCE_FIELDS = {"@timestamp", "message", "host", "log", "event", "input", "agent"}


def first_text() -> Column:
    """First non-blank text among the message and the two original fields."""
    candidates = [F.col(c) for c in ("message", "log.original", "event.original")]
    return F.coalesce(*[F.when(text.has_text(c), c) for c in candidates])


def flatten(sources: DataFrame, live: bool = False) -> DataFrame:
    """One flat row per document that still has a message.

    The scheduled path falls back to the original text, drops collector noise
    and strips prefix and tag; the live path only strips stamp and host.
    """
    extra = [c for c in sources.columns if c not in SOURCE_FIELDS]
    if live:
        rows = sources.withColumn("_message", text.strip_prefix_live(F.col("message"))).filter("_message != ''")
    else:
        raw = F.col("_raw")
        rows = sources.withColumn("_raw", first_text()).filter(raw.isNotNull() & ~text.is_noise(raw))
        rows = rows.withColumn("_raw", text.strip(raw)).withColumn("_message", text.strip_prefix_batch(raw))
    empty = F.lit("")
    return rows.select(
        F.coalesce(F.col("@timestamp"), empty).alias("@timestamp"),
        F.col("_message").alias("message"),
        text.shorten(F.col("_message"), 200).alias("message_short"),
        F.coalesce(F.col("host.name"), empty).alias("host"),
        F.coalesce(F.col("log.file.path"), empty).alias("log_file"),
        F.coalesce(F.col("input.type"), empty).alias("input_type"),
        F.coalesce(F.col("agent.name"), empty).alias("agent_name"),
        *extra,
    )


def scan_tally(sources: DataFrame) -> DataFrame:
    """How many documents were seen, dropped as blank, dropped as noise, kept."""
    raw = F.col("raw")
    state = F.when(raw.isNull(), "blank").when(text.is_noise(raw), "noise").otherwise("kept")
    states = sources.select(first_text().alias("raw")).select(state.alias("state"))
    return states.agg(
        F.count("*").alias("seen"),
        *[F.count_if(F.col("state") == name).alias(name) for name in ("blank", "noise", "kept")],
    )


def dedupe(
    logs: DataFrame,
    keys: tuple[str, ...] = ("@timestamp", "message"),
    order: tuple[str, ...] = ("host", "log_file"),
) -> DataFrame:
    """Keep one row per key, the first in ``order``.

    Rank-equals-one is cut down to one row per key before the exchange, so a
    key that fills a third of the table still sends one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return logs.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def logs_from(sources: DataFrame, live: bool = False, order: tuple[str, ...] = ("host", "log_file")) -> DataFrame:
    """The whole cleaning chain."""
    kept = flatten(sources, live)
    return kept if live else dedupe(kept, order=order)
