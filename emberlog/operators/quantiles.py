"""Exact quantiles of columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One in so many rows is what the approximate quantile may be off by.
ACCURACY = 10_000


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """The ``p`` quantile with linear interpolation; null rows are ignored.

    Spark's ``percentile`` keeps every distinct value in one task's memory.
    Here approximate quantiles bracket the rank, a second pass counts what is
    below and inside the bracket, and only the inside, a few rows in ten
    thousand and whatever equals its bounds, is looked at a third time. Equal
    values are counted, not sorted, so neither repeats nor infinities cost more.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    margin = 2 / ACCURACY
    shares = F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin)))
    n, lo, hi, ends = values.agg(
        F.count("*"), F.min("v"), F.max("v"), F.percentile_approx("v", shares, F.lit(ACCURACY))).first()
    if n == 0:
        return None
    position = p * (n - 1)
    rank = math.floor(position)
    wanted = range(rank, min(rank + 1, n - 1) + 1)
    low, high = (lo if p <= margin else ends[0]), (hi if p >= 1 - margin else ends[1])
    below, inside = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    if not (below <= wanted[0] and wanted[-1] < below + inside):
        # The bracket missed; the whole range holds the rank for certain.
        low, high, below = lo, hi, 0
    counts = values.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    found = [_value_at(counts, r - below) for r in wanted]
    first, second = found[0], found[-1]
    return first if first == second else first + (second - first) * (position - rank)


def percentile_of_counts(counts: DataFrame, p: float) -> float | None:
    """The same of distinct values ``v``, each of which counts ``n`` times."""
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    position = p * (total - 1)
    rank = math.floor(position)
    first, second = _value_at(counts, rank), _value_at(counts, min(rank + 1, total - 1))
    return first if first == second else first + (second - first) * (position - rank)


def _value_at(counts: DataFrame, rank: int) -> float:
    """The value at ``rank`` among distinct values with their counts.

    Range partitions of the sorted values are summed first, so the running sum
    is over one number per partition and then inside the one that matters.
    """
    parts = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    sums = sorted(parts.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r.lo)
    before = 0
    for part in sums:
        if rank < before + part.n:
            running = F.sum("n").over(W.orderBy("v"))
            inside = counts.filter(F.col("v").between(part.lo, part.hi)).withColumn("upto", running + before)
            return inside.filter(F.col("upto") > rank).agg(F.min("v")).first()[0]
        before += part.n
    raise AssertionError("the rank is beyond the last value")
