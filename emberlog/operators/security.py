"""Security and health questions over log and scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import text
from emberlog.operators.scoring import anomalies
from emberlog.sources.scan import between, newest

IP = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
FAILED_LOGIN = r"(?i)failed (?:login|password)"
BLOCKED = r"(?i)\bblock(?:ed)?\b"
# First match decides.
HEALTH = [
    ("memory", r"(?i)memory exhausted|out of memory|\boom"),
    ("disk", r"(?i)nearly full|no space left|disk space"),
    ("crash", r"(?i)exited with|failed with result|main process exited"),
    ("killed", r"(?i)\bkill(?:ed)?\b|terminated"),
]


def _start(window: str) -> Column:
    return F.window("ts", window)["start"]


def failed_logins(logs: DataFrame) -> DataFrame:
    ip = F.nullif(F.regexp_extract("message", rf"from {IP}", 1), F.lit(""))
    return logs.filter(F.col("message").rlike(FAILED_LOGIN)).withColumn("ip", ip)


def bruteforce(logs: DataFrame, threshold: int = 3, window: str = "10 minutes") -> DataFrame:
    """Sources with at least ``threshold`` failed logins in one window."""
    rows = failed_logins(logs).filter("ip IS NOT NULL AND ts IS NOT NULL")
    counts = rows.groupBy("ip", _start(window).alias("window_start")).agg(F.count("*").alias("failures"))
    return counts.filter(F.col("failures") >= threshold)


def login_sources(logs: DataFrame) -> DataFrame:
    """Failed logins per source, with first and last time."""
    return (
        failed_logins(logs).filter("ip IS NOT NULL").groupBy("ip")
        .agg(F.count("*").alias("failures"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )


def is_private(ip: Column) -> Column:
    """RFC 1918 test on the octets."""
    octets = F.split(ip, r"\.")
    first, second = octets[0].cast("int"), octets[1].cast("int")
    return (first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))


def blocked(logs: DataFrame) -> DataFrame:
    source = F.regexp_extract("message", rf"SRC={IP}", 1)
    port = F.regexp_extract("message", r"DPT=([0-9]+)", 1)
    rows = logs.filter(F.col("message").rlike(BLOCKED)).withColumns({"src": source, "port": port})
    return rows.filter("src <> '' AND port <> ''").withColumn("port", F.col("port").cast("int"))


def blocked_sources(logs: DataFrame) -> DataFrame:
    """Blocked connections per source, and whether it is an outside address."""
    counts = blocked(logs).groupBy("src").agg(F.count("*").alias("blocked"), F.count_distinct("port").alias("ports"))
    return counts.withColumn("external", (~is_private(F.col("src"))).cast("int"))


def port_scan(logs: DataFrame, ports: int = 3, window: str = "10 minutes") -> DataFrame:
    """Sources that tried at least ``ports`` distinct ports in one window."""
    rows = blocked(logs).filter("ts IS NOT NULL")
    counts = rows.groupBy("src", _start(window).alias("window_start")).agg(F.count_distinct("port").alias("ports"))
    return counts.filter(F.col("ports") >= ports)


def health_categories(logs: DataFrame) -> DataFrame:
    chain = F
    for name, pattern in HEALTH:
        chain = chain.when(F.col("message").rlike(pattern), name)
    rows = logs.select(chain.alias("category"), "host").filter("category IS NOT NULL")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


def template_patterns(logs: DataFrame) -> DataFrame:
    """Message shapes and how often each occurs."""
    return logs.groupBy(text.template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


def main_patterns(logs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent shapes."""
    return template_patterns(logs).orderBy(F.col("n").desc(), "template").limit(k)


def _with_previous(counts: DataFrame, bucket: str, step: str) -> DataFrame:
    """Add the count of the bucket one ``step`` earlier (0 if it had none).

    An equi-join on the shifted bucket: no window over the whole table.
    """
    earlier = counts.select((F.col(bucket) + F.expr(f"INTERVAL {step}")).alias(bucket), F.col("n").alias("previous"))
    joined = counts.join(earlier, bucket, "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return joined.withColumn("change", F.col("n") - F.col("previous"))


def day_over_day(scored: DataFrame) -> DataFrame:
    days = anomalies(scored).filter("ts IS NOT NULL").groupBy(F.date_trunc("day", "ts").alias("day"))
    return _with_previous(days.agg(F.count("*").alias("n")), "day", "1 day")


def cycle_counts(scored: DataFrame, window: str = fixed.CYCLE) -> DataFrame:
    """Anomalies per cycle and the change since the cycle before."""
    cycles = anomalies(scored).filter("ts IS NOT NULL").groupBy(_start(window).alias("cycle"))
    return _with_previous(cycles.agg(F.count("*").alias("n")), "cycle", window)


def sliding_counts(
    rows: DataFrame, slides: int = 20, slide: str = fixed.LIVE_PERIOD, slide_seconds: int = 15
) -> DataFrame:
    """Counts per sliding window (five minutes every 15 seconds by default).

    Rows are first summed per slide step; only those sums are then copied to
    the windows they fall in, not every row ``slides`` times.
    """
    panes = rows.filter("ts IS NOT NULL").groupBy(_start(slide).alias("pane")).agg(F.count("*").alias("n"))
    return windows_of_panes(panes, slides, slide_seconds)


def windows_of_panes(panes: DataFrame, slides: int = 20, slide_seconds: int = 15) -> DataFrame:
    """Sliding windows from the sums ``pane, n`` of their steps."""
    back = F.explode(F.sequence(F.lit(0), F.lit(slides - 1))).alias("k")
    spread = panes.select("pane", "n", back)
    start = F.col("pane") - F.make_dt_interval(secs=(F.col("k") * slide_seconds).cast("decimal(18,6)"))
    return spread.groupBy(start.alias("window_start")).agg(F.sum("n").alias("n"))


def summary_between(scored: DataFrame, span: str = "1 hour", now: str | None = None) -> DataFrame:
    """Totals and severities of the last ``span`` up to ``now`` (default: latest row)."""
    now = newest(scored) if now is None else now
    end = F.lit(now).cast("timestamp")
    rows = between(scored, end - F.expr(f"INTERVAL {span}"), end, open_start=True)
    hit = F.col("anomaly") == -1
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("anomalies"),
        *[F.count_if(hit & (F.col("severity") == s)).alias(s.lower()) for s in fixed.SEVERITY_LEVELS],
    )


def impact(scored: DataFrame) -> DataFrame:
    rows = anomalies(scored)
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return rows.agg(
        F.count("*").alias("anomalies"),
        F.max("anomaly_score_norm").alias("max_score"),
        F.avg("anomaly_score_norm").alias("avg_score"),
        F.coalesce(F.try_divide(critical * 100, F.count("*")), F.lit(0.0)).alias("critical_pct"),
    )


def critical_today(scored: DataFrame, now=None) -> DataFrame:
    """Critical anomalies of the day of ``now`` (default: of the latest row)."""
    now = newest(scored) if now is None else now
    end = F.lit(now).cast("timestamp")
    return anomalies(between(scored, F.date_trunc("day", end), end)).filter(F.col("severity") == "CRITICAL")


def most_severe_per_day(scored: DataFrame, tie_break: tuple[str, ...] = ("message",)) -> DataFrame:
    """Each day's anomaly with the highest score."""
    rows = anomalies(scored).filter("ts IS NOT NULL").withColumn("date", F.to_date("ts"))
    rank = F.row_number().over(W.partitionBy("date").orderBy(F.col("anomaly_score_norm").desc(), "ts", *tie_break))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def next_bucket(scored: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Least-squares expectation for the bucket after the last one seen."""
    number = F.floor(F.unix_timestamp("ts") / bucket_seconds)
    counts = anomalies(scored).filter("ts IS NOT NULL").groupBy(number.alias("b")).agg(F.count("*").alias("n"))
    first = counts.agg(F.min("b")).scalar()
    x = F.col("b") - first
    line = counts.select(x.cast("double").alias("x"), F.col("n").cast("double").alias("n")).agg(
        F.count("*").alias("buckets"),
        F.regr_slope("n", "x").alias("slope"),
        F.regr_intercept("n", "x").alias("intercept"),
        (F.max("x") + 1).alias("next"),
    )
    return line.withColumn("expected", F.col("intercept") + F.col("slope") * F.col("next"))
