"""When anomalies happen: hourly and weekday counts, peaks, direction, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import times
from emberlog.operators.features import time_features
from emberlog.operators.scoring import anomalies


def with_time_columns(scored: DataFrame) -> DataFrame:
    """Hour and weekday, derived only where the table lacks them."""
    if "hour" not in scored.columns or "day_of_week" not in scored.columns:
        scored = time_features(scored)
    return scored.withColumn("day_name", times.day_name(F.col("day_of_week")))


def hourly_counts(scored: DataFrame) -> DataFrame:
    return with_time_columns(anomalies(scored)).groupBy("hour").agg(F.count("*").alias("anomalies"))


def weekday_counts(scored: DataFrame) -> DataFrame:
    return with_time_columns(anomalies(scored)).groupBy("day_name").agg(F.count("*").alias("anomalies"))


def peak(counts: DataFrame, key: str) -> DataFrame:
    """The key with the highest count; the smallest key on a tie."""
    return counts.orderBy(F.col("anomalies").desc(), key).limit(1)


def off_hours(scored: DataFrame) -> DataFrame:
    early = F.col("hour") < fixed.OFF_HOURS_END
    return with_time_columns(anomalies(scored)).agg(
        F.count_if(early).alias("off_hours"), F.count("*").alias("anomalies")
    )


def _total(cells: Column, keep) -> Column:
    return F.aggregate(F.filter(cells, keep), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def trends(scored: DataFrame) -> DataFrame:
    """One row with every trend figure, also when there is no anomaly.

    The table is read once and reduced to one cell per hour, weekday and
    severity (at most a few hundred, whatever the input); all figures are
    array expressions over those cells.
    """
    rows = with_time_columns(anomalies(scored))
    level = F.col("severity") if "severity" in rows.columns else F.lit(None).cast("string")
    cells = rows.groupBy("hour", "day_name", level.alias("severity")).agg(F.count("*").alias("n"))
    one = cells.agg(F.collect_list(F.struct("hour", "day_name", "severity", "n")).alias("cells"))
    cell = F.col("cells")
    hours = F.sequence(F.lit(0), F.lit(23))
    # Alphabetical, because that is how a tie between days is broken.
    days = F.array(*[F.lit(d) for d in sorted([*fixed.DAY_NAMES, "Unknown"])])
    levels = F.array(*[F.lit(s) for s in fixed.SEVERITY_LEVELS])
    per = lambda keys, field: F.filter(
        F.transform(keys, lambda k: F.struct(k.alias("key"), _total(cell, lambda x: x[field] == k).alias("n"))),
        lambda x: x["n"] > 0,
    )
    one = one.select(
        per(hours, "hour").alias("hourly"),
        per(days, "day_name").alias("daily"),
        per(levels, "severity").alias("severities"),
        _total(cell, lambda x: x["hour"] < fixed.OFF_HOURS_END).alias("off_hours"),
        _total(cell, lambda x: F.lit(True)).alias("anomalies"),
    )
    # First entry wins a tie: entries are in key order, so rank by -position.
    top = lambda c: F.element_at(
        c, (1 - F.array_max(F.transform(c, lambda x, i: F.struct(x["n"], -i)))["col2"]).cast("int")
    )
    hourly = F.col("hourly")
    direction = (
        F.when(F.size(hourly) < fixed.TREND_MIN_HOURS, "Stable")
        .when(F.col("slope") > fixed.TREND_SLOPE, "Increasing")
        .when(F.col("slope") < -fixed.TREND_SLOPE, "Decreasing")
        .otherwise("Stable")
    )
    return (
        one.withColumn("peak_hour", F.when(F.size(hourly) > 0, top(hourly)))
        .withColumn("peak_day", F.when(F.size("daily") > 0, top(F.col("daily"))))
        .join(F.broadcast(_slope(one)), how="left")
        .withColumn("trend", direction)
    )


def _slope(one: DataFrame) -> DataFrame:
    """One row: the slope of the hourly counts against 0, 1, 2, ...; null for fewer than two hours."""
    points = one.select(F.posexplode("hourly").alias("x", "hour"))
    slope = F.regr_slope(F.col("hour.n").cast("double"), F.col("x").cast("double"))
    # A slope of just a half must not pass it by the last bit.
    return points.agg(F.round(slope, 12).alias("slope"))


def trend_direction(scored: DataFrame) -> DataFrame:
    """Slope of the count over the hours present, in order, gaps closed up."""
    return trends(scored).select(F.size("hourly").alias("hours"), "slope", "trend")


def insights(scored: DataFrame) -> DataFrame:
    """The trend figures as sentences, in reading order."""
    row = trends(scored)
    count_of = lambda level: F.try_element_at(F.map_from_entries("severities"), F.lit(level))
    lines = [
        F.format_string(fixed.INSIGHT_PEAK_HOUR, F.col("peak_hour.key"), F.col("peak_hour.n")),
        F.format_string(fixed.INSIGHT_PEAK_DAY, F.col("peak_day.key"), F.col("peak_day.n")),
        F.format_string(fixed.INSIGHT_TREND, F.col("trend")),
    ]
    shown = [F.lit(True)] * 3
    for level in fixed.SEVERITY_LEVELS[:4]:
        lines.append(F.format_string(fixed.INSIGHT_SEVERITY, F.lit(level), count_of(level)))
        shown.append(count_of(level).isNotNull())
    lines.append(F.format_string(fixed.INSIGHT_OFF_HOURS, F.col("off_hours")))
    shown.append(F.col("off_hours") > 0)
    some = F.col("anomalies") > 0
    entries = [
        F.when(some & show, F.struct(F.lit(i).alias("ord"), line.alias("text")))
        for i, (line, show) in enumerate(zip(lines, shown))
    ]
    entries.append(F.when(~some, F.struct(F.lit(0).alias("ord"), F.lit(fixed.INSIGHT_EMPTY).alias("text"))))
    return row.select(F.inline(F.array_compact(F.array(*entries))))
