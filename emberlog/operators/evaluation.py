"""How good the detector is, from its own output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators.quantiles import exact_percentile
from emberlog.operators.scoring import anomalies

def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def label_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("anomaly").agg(F.count("*").alias("n"))


def severity_counts(scored: DataFrame) -> DataFrame:
    return anomalies(scored).groupBy("severity").agg(F.count("*").alias("n"))


def severity_bars(scored: DataFrame, width: int = 40) -> DataFrame:
    bar = F.repeat(F.lit("█"), F.least(F.col("n"), F.lit(width)).cast("int"))
    return severity_counts(scored).withColumn("bar", bar)


def basic_stats(scored: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("anomaly") == -1)
    counts = scored.agg(F.count("*").alias("total"), hit.alias("anomalies"))
    rate = _ratio(F.col("anomalies"), F.col("total"))
    return counts.withColumn("normal", F.col("total") - F.col("anomalies")).withColumn("rate", rate)


def score_stats(scored: DataFrame, approximate: bool = False, quantile: bool = True) -> DataFrame:
    """Mean and spread of the score per class, range, threshold, norm quantile.

    A class without rows gives 0; a class of one gives a null spread. The
    quantile takes passes of its own; without it one pass does.
    """
    score, norm, label = F.col("anomaly_score"), F.col("anomaly_score_norm"), F.col("anomaly")
    hit, miss = F.when(label == -1, score), F.when(label == 1, score)
    hit_norm = F.when(label == -1, norm)
    or_zero = lambda agg, of: F.when(F.count(of) == 0, F.lit(0.0)).otherwise(agg)
    stats = scored.agg(
        or_zero(F.avg(hit), hit).alias("score_anom_mean"),
        or_zero(F.stddev_samp(hit), hit).alias("score_anom_std"),
        or_zero(F.avg(miss), miss).alias("score_norm_mean"),
        or_zero(F.stddev_samp(miss), miss).alias("score_norm_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        or_zero(F.max(hit), hit).alias("score_threshold"),
        or_zero(F.avg(hit_norm), hit_norm).alias("norm_score_mean"),
        or_zero(F.max(hit_norm), hit_norm).alias("norm_score_max"),
    )
    return stats.withColumn("norm_score_p95", F.lit(norm_p95(scored, approximate))) if quantile else stats


def norm_p95(scored: DataFrame, approximate: bool = False) -> float:
    """95th percentile of the norm among anomalies, 0 when there are none."""
    hits = anomalies(scored)
    if approximate:
        return hits.agg(F.coalesce(F.percentile_approx("anomaly_score_norm", 0.95), F.lit(0.0))).first()[0]
    return exact_percentile(hits, "anomaly_score_norm", 0.95) or 0.0


def confusion(
    rows: DataFrame,
    label_cols: tuple[str, ...] = ("contains_error", "contains_login", "contains_warning"),
    predicted: Column | None = None,
) -> DataFrame:
    """Prediction against a weak label: 1 when any of ``label_cols`` is 1."""
    weak = F.lit(False)
    for name in label_cols:
        if name in rows.columns:
            weak = weak | (F.coalesce(F.col(name), F.lit(0)) == 1)
    hit = F.col("anomaly") == -1 if predicted is None else predicted
    flags = rows.select(weak.alias("weak"), hit.alias("hit"))
    weak, hit = F.col("weak"), F.col("hit")
    cells = flags.agg(
        F.count_if(hit & weak).alias("tp"),
        F.count_if(hit & ~weak).alias("fp"),
        F.count_if(~hit & weak).alias("fn"),
        F.count_if(~hit & ~weak).alias("tn"),
    )
    tp, precision, recall = F.col("tp"), F.col("precision"), F.col("recall")
    return (
        cells.withColumn("precision", _ratio(tp, tp + F.col("fp")))
        .withColumn("recall", _ratio(tp, tp + F.col("fn")))
        .withColumn("f1", _ratio(2 * precision * recall, precision + recall))
    )


def feature_diff(scored: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """|mean among anomalies - mean among the rest| per feature, largest first."""
    cols = [c for c in (cols or fixed.FEATURES["full"]) if c in scored.columns]
    mean = lambda c, label: F.avg(F.when(F.col("anomaly") == label, F.col(c)))
    one = scored.agg(*[F.abs(mean(c, -1) - mean(c, 1)).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "diff").orderBy(F.col("diff").desc(), "feature")


def histogram(df: DataFrame, col: str, bins: int = 10, width: int = 32) -> DataFrame:
    """Equal-width bins over the column's range, the last one closed.

    Every bin is present, empty or not. A constant column is one bin.
    """
    value = F.col(col).cast("double")
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    rows = df.select(value.alias("v"), lo.alias("lo"), hi.alias("hi")).filter("v IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / bins
    # Comparing with each edge keeps a value that equals an edge in its bin.
    bin_of = F.lit(1)
    for i in range(1, bins):
        bin_of = bin_of + (F.col("v") >= F.lit(i) * step + F.col("lo")).cast("int")
    bin_of = F.when(F.col("lo") == F.col("hi"), 1).otherwise(bin_of)
    counts = rows.groupBy(bin_of.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    range_row = counts.agg(F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"),
                           F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    last = F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)
    dense = range_row.filter("lo IS NOT NULL").select(
        F.explode(F.sequence(F.lit(1), last)).alias("bin"), "lo", "hi", "found"
    )
    step = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0))
    most = F.array_max(F.map_values("found"))
    return dense.select(
        "bin",
        ((F.col("bin") - 1) * step + F.col("lo")).alias("edge"),
        n.alias("n"),
        F.repeat(F.lit("█"), F.floor(n / most * width).cast("int")).alias("bar"),
    )
