"""Readiness of the tables a run depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def readiness(table: DataFrame, name: str, columns: list[str], time_col: str = "ts") -> DataFrame:
    """Rows ``(name, ok, detail, critical)``, one pass over the table."""
    missing = [c for c in columns if c not in table.columns]
    newest = F.max(time_col) if time_col in table.columns else F.lit(None).cast("timestamp")
    one = table.agg(F.count("*").alias("n"), newest.cast("string").alias("newest"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" rows"))
    checks = [
        (f"{name} not empty", F.col("n") > 0, detail, True),
        (f"{name} columns", F.lit(not missing), F.lit(", ".join(missing) or "all present"), True),
        (f"{name} newest", F.col("newest").isNotNull(), F.coalesce("newest", F.lit("none")), False),
    ]
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), ok.alias("ok"), d.alias("detail"), F.lit(c).alias("critical"))
        for n, ok, d, c in checks
    ])
    return one.select(F.inline(rows))


def overall(checks: DataFrame) -> DataFrame:
    """True when every critical check holds."""
    return checks.agg(F.coalesce(F.bool_and(F.when(F.col("critical"), F.col("ok"))), F.lit(True)).alias("ok"))
