"""The tables behind the report page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import severity, text
from emberlog.operators.evaluation import severity_counts
from emberlog.operators.scoring import anomalies
from emberlog.operators.trends import hourly_counts


def severity_share(scored: DataFrame) -> DataFrame:
    """Count and percentage of all five severities, absent ones as 0.

    Anomalies without a severity count for none of them.
    """
    levels = F.array(*[F.lit(s) for s in fixed.SEVERITY_LEVELS])
    found = severity_counts(scored).filter("severity IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("found"))
    rows = found.select(F.posexplode(levels).alias("ord", "severity"), "found")
    n = F.coalesce(F.try_element_at("found", F.col("severity")), F.lit(0))
    total = F.aggregate(F.map_values("found"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("ord", "severity", n.alias("n"), (n / F.greatest(total, F.lit(1)) * 100).alias("pct"))


def heatmap(scored: DataFrame) -> DataFrame:
    """All 24 hours with their count, share of the busiest hour and shade. Rows without an hour are left out."""
    found = hourly_counts(scored).filter("hour IS NOT NULL").agg(
        F.map_from_entries(F.collect_list(F.struct("hour", "anomalies"))).alias("found")
    )
    rows = found.select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), "found")
    n = F.coalesce(F.try_element_at("found", F.col("hour")), F.lit(0))
    most = F.array_max(F.map_values("found"))
    share = F.coalesce(F.try_divide(n, most), F.lit(0.0))
    hot, warm = fixed.HEATMAP_CUTS
    base, gain = fixed.HEATMAP_OPACITY
    shade = F.when(F.col("share") > hot, "hot").when(F.col("share") > warm, "warm").otherwise("cool")
    return (
        rows.select("hour", n.alias("anomalies"), share.alias("share"))
        .withColumn("shade", shade)
        .withColumn("opacity", F.lit(base) + F.col("share") * gain)
    )


def top_anomalies(scored: DataFrame, k: int, tie_break: tuple[str, ...] = ("@timestamp", "message")) -> DataFrame:
    """The k highest-scoring anomalies; a top-k, not a full sort."""
    first = F.col("anomaly_score_norm").desc() if "anomaly_score_norm" in scored.columns else F.col(scored.columns[0]).desc()
    return anomalies(scored).orderBy(first, *tie_break).limit(k)


def top_table(scored: DataFrame, k: int = 20, tie_break: tuple[str, ...] = ("@timestamp", "message")) -> DataFrame:
    """Top anomalies as the report prints them."""
    return top_anomalies(scored, k, tie_break).select(
        text.shorten(F.col("@timestamp"), 19).alias("timestamp"),
        "severity",
        severity.symbol(F.col("severity")).alias("symbol"),
        F.format_string("%.4f", "anomaly_score_norm").alias("score"),
        text.escape_html(text.shorten(F.col("message"), 120)).alias("message"),
    )


def first_anomalies(scored: DataFrame, k: int = 10, order: tuple[str, ...] = ("ts", "message")) -> DataFrame:
    """The earliest k anomalies, message cut for display."""
    rows = anomalies(scored).orderBy(*order).limit(k)
    return rows.withColumn("message", text.shorten(F.col("message"), 100))
