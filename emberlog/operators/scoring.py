"""Labels, normalised scores and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import severity
from emberlog.operators.quantiles import exact_percentile


def anomalies(scored: DataFrame) -> DataFrame:
    """The rows labelled -1; all rows when nothing is labelled."""
    return scored.filter("anomaly = -1") if "anomaly" in scored.columns else scored


def label(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """-1 below zero on the decision scale, +1 from zero on."""
    return df.withColumn("anomaly", F.when(F.col(score) < 0, -1).otherwise(1))


def label_by_contamination(
    df: DataFrame, score: str = "anomaly_score", contamination: float = fixed.CONTAMINATION
) -> DataFrame:
    """-1 for scores under the contamination quantile of this batch."""
    cut = exact_percentile(df, score, contamination)
    return df.withColumn("anomaly", F.when(F.col(score) < F.lit(cut), -1).otherwise(1))


def normalize(
    df: DataFrame,
    score: str = "anomaly_score",
    out: str = "anomaly_score_norm",
    orientation: str = "high",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Min-max scale the score to 0..1.

    ``orientation="high"`` puts 1 at the most anomalous row (a batch of equal
    scores becomes all 1); ``"low"`` is the older scale, 1 at the highest raw
    score and null for a constant batch. Scores beyond given bounds count as the
    nearer bound. Bounds default to this batch's own,
    read as one scalar; pass those of training to compare batches.
    """
    if bounds is None:
        ends = df.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
        low, high = ends["low"], ends["high"]
    else:
        low, high = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    value = F.col(score) if bounds is None else F.when(F.col(score).isNotNull(), F.greatest(low, F.least(high, F.col(score))))
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    if orientation == "high":
        share = 1.0 - F.coalesce(share, F.when(F.col(score).isNotNull(), F.lit(0.0)))
    return df.withColumn(out, share)


def with_severity(df: DataFrame, norm: str = "anomaly_score_norm") -> DataFrame:
    return df.withColumn("severity", severity.from_norm(F.col(norm)))


def finish(df: DataFrame) -> DataFrame:
    """Decision score to label, norm and severity."""
    return with_severity(normalize(label(df)))
