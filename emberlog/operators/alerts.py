"""Alerts: which documents are due for one, and their text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import severity, text

BLOCK = 86_400  # seconds; candidates are at most one per second and key


def actionable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("severity").isin(fixed.ACTIONABLE))


def alert_text(df: DataFrame, out: str = "text") -> DataFrame:
    """The line sent out: severity, score, time (N/A if unknown), message cut at 400."""
    stamp = F.when(F.col("timestamp").isNull() | (F.col("timestamp") == ""), "N/A").otherwise(F.col("timestamp"))
    parts = [
        F.concat(severity.symbol(F.col("severity")), F.lit(" Log alert")),
        F.concat(F.lit("Severity: "), F.col("severity")),
        F.format_string("Score: %.4f", "anomaly_score_norm"),
        F.concat(F.lit("Time: "), stamp),
        F.concat(F.lit("Message: "), text.shorten(F.col("message"), 400)),
    ]
    return df.withColumn(out, F.concat_ws("\n", *parts))


def candidates(docs: DataFrame, key: str = "severity") -> DataFrame:
    """One document per key and second: the highest score, then the lowest id.

    Time is cut to whole seconds first, so the one kept is as due as any.
    """
    second = F.unix_timestamp(F.to_timestamp("timestamp"))
    rank = F.row_number().over(W.partitionBy(key, "second").orderBy(F.col("anomaly_score_norm").desc(), "doc_id"))
    rows = docs.withColumn("second", second).withColumn("_rank", rank)
    return rows.filter("_rank = 1").drop("_rank")


def _next_due(seconds: np.ndarray, gap: int) -> np.ndarray:
    """For each candidate, the index of the first one ``gap`` later."""
    return np.searchsorted(seconds, seconds + gap)


def _block_exits(gap: int):
    """Per block: the wait it leaves behind, for every wait it may start with."""

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = np.sort(pdf["second"].to_numpy())
        start = int(pdf["block"].iloc[0]) * BLOCK
        following = np.append(_next_due(seconds, gap), len(seconds))
        at = np.searchsorted(seconds, start + np.arange(gap + 1))
        last = np.full(gap + 1, -1)
        while (at < len(seconds)).any():
            last = np.where(at < len(seconds), at, last)
            at = following[at]
        end = start + BLOCK
        carried = np.maximum(start + np.arange(gap + 1) - end, 0)
        left = np.where(last >= 0, np.maximum(seconds[last] + gap - end, 0), carried)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "block": [pdf["block"].iloc[0]], "exits": [left.tolist()]})

    return exits


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one key in order: the wait each one starts with."""
    pdf = pdf.sort_values("block")
    waits, wait, previous = [], 0, None
    for block, exits in zip(pdf["block"], pdf["exits"]):
        wait = wait if previous is not None and block == previous + 1 else 0
        waits.append(wait)
        wait, previous = int(exits[wait]), block
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "wait": waits})


def _pick(gap: int):
    """The candidates of one block that are sent, given its starting wait."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = np.sort(pdf["second"].to_numpy())
        start = int(pdf["block"].iloc[0]) * BLOCK + int(pdf["wait"].iloc[0])
        following = _next_due(seconds, gap)
        sent, at = [], int(np.searchsorted(seconds, start))
        while at < len(seconds):
            sent.append(int(seconds[at]))
            at = int(following[at])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "second": sent}).astype({"second": "int64"})

    return pick


def cooldown(due: DataFrame, key: str = "severity", seconds: int = fixed.COOLDOWN_SECONDS) -> DataFrame:
    """Of ``candidates``, those sent when at least ``seconds`` lie between sends.

    A suppressed row does not restart the clock, so each decision hangs on the
    one before it. With five keys that would be five tasks; instead each key
    is cut into days. Every day works out, in parallel, what wait it leaves
    behind for each wait it could start with; chaining those short maps gives
    the real starting wait of every day; then the days pick in parallel.
    """
    if not 0 < seconds <= BLOCK:
        raise ValueError("the cooldown must be between one second and one day")
    times = due.select(F.col(key).alias("key"), "second", F.floor(F.col("second") / BLOCK).alias("block"))
    exits = times.groupBy("key", "block").applyInPandas(
        _block_exits(seconds), "key string, block long, exits array<int>"
    )
    waits = exits.groupBy("key").applyInPandas(_chain, "key string, block long, wait int")
    sent = (
        times.join(waits, ["key", "block"])
        .groupBy("key", "block")
        .applyInPandas(_pick(seconds), "key string, second long")
    )
    return due.join(sent.withColumnRenamed("key", key), [key, "second"], "left_semi")
