"""Numeric features of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import text, times
from emberlog.operators.grouping import attach_count


def text_features(df: DataFrame, profile: str = "full", col: str = "message") -> DataFrame:
    """Length, keyword flags, digit and word counts, share of capitals."""
    c = F.col("_text")
    features = {"msg_length": F.length(c)}
    features |= {name: text.flag(c, words) for name, words in fixed.KEYWORDS[profile].items()}
    features["digit_count"] = text.digit_count(c)
    if profile == "full":
        features["word_count"] = text.word_count(c)
        features["uppercase_ratio"] = text.uppercase_ratio(c)
    filled = df.withColumn("_text", F.coalesce(F.col(col), F.lit("")))
    return filled.withColumns(features).drop("_text")


def time_features(df: DataFrame, col: str = "@timestamp") -> DataFrame:
    """UTC hour and weekday; 0 where the stamp is not a time or absent."""
    if col not in df.columns:
        col = "timestamp"
    if col not in df.columns:
        return df.withColumns({"hour": F.lit(0), "day_of_week": F.lit(0)})
    ts = F.col("ts") if "ts" in df.columns else times.parse(F.col(col))
    return df.withColumns({"hour": times.hour(ts), "day_of_week": times.day_of_week(ts)})


def frequency_feature(df: DataFrame, col: str = "message") -> DataFrame:
    """How often the same message occurs in this batch."""
    return attach_count(df, col, "message_frequency")


def basic_features(logs: DataFrame, profile: str = "full") -> DataFrame:
    """All numeric features of a profile, in model order."""
    filled = logs.withColumn("message", F.coalesce(F.col("message"), F.lit("")))
    if profile == "narrow":
        return text_features(filled, profile)
    return text_features(time_features(frequency_feature(filled)), profile)
