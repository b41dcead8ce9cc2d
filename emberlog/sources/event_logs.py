"""Log documents derived from an ``events`` table.

Gives every event a log line of one of sixteen classes (failed logins, blocked
packets, resource exhaustion, warnings, blank and noisy lines, normal traffic),
so that each operator meets the inputs it exists for. One scan, no shuffle; the
result grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _message(k: Column, event_id: Column, user_id: Column, event_type: Column) -> Column:
    by_class = [
        _text("Failed login for operator from 198.51.100.", user_id % 3 + 1, " port ", 1024 + event_id % 60000),
        _text("Blocked inbound packet SRC=203.0.113.", user_id % 3 + 1, " DPT=", 20 + event_id % 400),
        _text("Memory exhausted, terminated worker ", event_id, " after exception"),
        F.lit("CRITICAL volume nearly full on /data"),
        _text("Warning: clock drift ", event_id % 50, " ms"),
        F.lit("service billing exited with ERROR status 3"),
        _text("auth token refreshed for user ", user_id),
        F.lit("SSH session opened"),
        F.lit("   "),
        F.lit(None).cast("string"),
        F.lit('{"log.level":"info","msg":"Non-zero metrics"}'),
        F.lit("2024-01-05T10:00:00.123456+05:30 node-7 sshd[88]: Accepted key for deploy"),
    ]
    chain = F
    for number, line in enumerate(by_class):
        chain = chain.when(k == number, line)
    return chain.otherwise(_text("Request ", event_type, " handled in ", event_id % 7, " ms"))


def source_documents(events: DataFrame) -> DataFrame:
    """Nested source documents, plus the event's own columns.

    Failed logins and blocked packets are moved to the first ten minutes of
    their day (bursts), some stamps are broken, and every fiftieth event is
    shipped twice.
    """
    event_id, user_id, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    k = event_id % 16
    burst = F.date_trunc("day", ts) + F.make_dt_interval(secs=(event_id % 600).cast("decimal(18,6)"))
    moment = F.when(k.isin(0, 1), burst).otherwise(ts.cast("timestamp"))
    stamp = (
        F.when(event_id % 97 == 5, "not-a-time")
        .when(event_id % 89 == 7, "")
        .otherwise(F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    )
    original = F.when((k == 9) & (event_id % 3 == 0), _text("fallback original ", event_id))
    copies = F.sequence(F.lit(0), F.when(event_id % 50 == 0, 1).otherwise(0))
    return events.select(
        stamp.alias("@timestamp"),
        _message(k, event_id, user_id, F.col("event_type")).alias("message"),
        F.struct(_text("host-", user_id % 10).alias("name")).alias("host"),
        F.struct(
            original.alias("original"),
            F.struct(_text("/var/log/app", event_id % 3, ".log").alias("path")).alias("file"),
        ).alias("log"),
        F.struct(F.lit(None).cast("string").alias("original")).alias("event"),
        F.struct(F.lit("log").alias("type")).alias("input"),
        F.struct(F.lit("collector").alias("name")).alias("agent"),
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.explode(copies).alias("copy"),
    )
