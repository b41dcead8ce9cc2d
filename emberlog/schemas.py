"""Schemas of the tables that flow through the package."""

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# A log document as a collector ships it.
SOURCE = T.StructType(
    [
        T.StructField("@timestamp", S),
        T.StructField("message", S),
        T.StructField("host", _struct(name=S)),
        T.StructField("log", _struct(original=S, file=_struct(path=S))),
        T.StructField("event", _struct(original=S)),
        T.StructField("input", _struct(type=S)),
        T.StructField("agent", _struct(name=S)),
    ]
)

# The flat log table.
LOG = T.StructType(
    [T.StructField(n, S) for n in (
        "@timestamp", "message", "message_short", "host", "log_file", "input_type", "agent_name")]
)

# Log table plus the numeric features, in model order.
FEATURE = T.StructType(
    LOG.fields
    + [T.StructField(n, D if n == "uppercase_ratio" else I) for n in (
        "msg_length", "contains_error", "contains_login", "contains_warning", "digit_count",
        "word_count", "uppercase_ratio", "hour", "day_of_week", "message_frequency")]
)

# Feature table plus label, scores and severity.
SCORED = T.StructType(
    FEATURE.fields
    + [
        T.StructField("anomaly", I),
        T.StructField("anomaly_score", D),
        T.StructField("anomaly_score_norm", D),
        T.StructField("severity", S),
    ]
)

# The keyed document kept per anomaly.
ANOMALY_DOC = T.StructType(
    [
        T.StructField("doc_id", S),
        T.StructField("timestamp", S),
        T.StructField("message", S),
        T.StructField("severity", S),
        T.StructField("anomaly", I),
        T.StructField("anomaly_score", D),
        T.StructField("anomaly_score_norm", D),
        T.StructField("msg_length", I),
        T.StructField("error_flag", I),
        T.StructField("login_flag", I),
        T.StructField("warning_flag", I),
        T.StructField("digit_count", I),
        T.StructField("word_count", I),
        T.StructField("hour", I),
        T.StructField("day_of_week", I),
        T.StructField("message_short", S),
    ]
)


def require_columns(df, *names: str) -> None:
    """Fail at plan time, without a job, when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
