"""Scans over source documents by time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import times
from emberlog.session import stage


def with_time(df: DataFrame, col: str = "@timestamp") -> DataFrame:
    """Parse the stamp once, into ``ts``."""
    return df if "ts" in df.columns else df.withColumn("ts", times.parse(F.col(col)))


def between(df: DataFrame, start: datetime | str | Column, end: datetime | str | Column, open_start: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end``, both included unless ``open_start``.

    Every filter on time goes through here: a table kept by ``day`` is pruned
    to its days, and bounds that are values reach the Parquet reader.
    """
    ts, start, end = F.col("ts"), _time(start), _time(end)
    rows = with_time(df).filter((ts > start if open_start else ts >= start) & (ts <= end))
    return rows.filter(F.col("day").between(F.to_date(start), F.to_date(end))) if "day" in df.columns else rows


def _time(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def newest(df: DataFrame) -> datetime | None:
    """The latest time of a table; one small pass."""
    return with_time(df).agg(F.max("ts")).first()[0]


def start_of_scan(mark: datetime | str | None, now: datetime | str | Column) -> Column:
    """The mark, or the default look-back when there is none yet."""
    return F.coalesce(F.lit(mark).cast("timestamp"), _time(now) - F.expr(f"INTERVAL {fixed.SCAN_LOOKBACK}"))


def incremental_scan(
    df: DataFrame,
    mark: datetime | str | None,
    now: datetime | str,
    limit: int | None = None,
    tie_break: tuple[str, ...] = (),
) -> DataFrame:
    """Rows with ``mark <= ts <= now``, both ends included.

    ``limit`` is the optional per-cycle cap, oldest first; with it the result
    is a top-k and never a full sort. A capped scan goes on with ``next_page``.
    """
    rows = between(df, start_of_scan(mark, now), now)
    return rows if limit is None else rows.orderBy("ts", *tie_break).limit(limit)


def next_page(df: DataFrame, cursor: tuple | None, mark: datetime | str | None, now: datetime | str,
              limit: int, ids: tuple[str, ...]) -> DataFrame:
    """The oldest ``limit`` rows behind ``cursor``, the (ts, \\*ids) of the last row read.

    Rows that share a time are told apart by ``ids``, so none is skipped or
    read twice however many there are. Without a cursor the range begins at
    ``mark``.
    """
    if cursor is None:
        rows = incremental_scan(df, mark, now)
    else:
        rows = between(df, cursor[0], now).filter(_behind(cursor, ids))
    return rows.orderBy("ts", *ids).limit(limit)


def paged(df: DataFrame, start: datetime | str | Column, end: datetime | str | Column, limit: int, ids: tuple[str, ...],
          after: tuple | None = None, first: int = 0) -> DataFrame:
    """All rows from ``start`` to ``end`` with the ``page`` that a capped scan reads them in, ``limit`` rows a page.

    What ``next_page`` would read page after page, in one job: pages follow
    from row numbers by (ts, \\*ids). With ``after``, a cursor, only rows
    behind it are numbered, from page ``first`` on.
    """
    from emberlog.operators.ranking import with_row_number

    rows = between(df, start if after is None else after[0], end)
    if after is not None:
        rows = rows.filter(_behind(after, ids))
    numbered = with_row_number(rows, ("ts", *ids))
    return numbered.withColumn("page", (F.col("number") / limit).cast("long") + first).drop("number")


def _behind(cursor: tuple, ids: tuple[str, ...]) -> Column:
    return F.struct("ts", *ids) > F.struct(*[F.lit(v).alias(n) for n, v in zip(("ts", *ids), cursor)])


def page_ends(pages: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The cursor each page leaves behind, ``ts, *ids, step``, and its ``rows``."""
    last = F.max(F.struct("ts", *ids)).alias("last")
    ends = pages.groupBy(F.col("page").alias("step")).agg(last, F.count("*").alias("rows"))
    return ends.select("last.*", "step", "rows")


def save_cursors(ends: DataFrame, path: str) -> None:
    """Keep the cursors of many pages in the state table; ``load_cursor`` finds the last one."""
    ends.drop("rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def cursor_after(page: DataFrame, ids: tuple[str, ...]) -> tuple | None:
    """Where the page behind this one begins; None for an empty page.

    Take it from the page as it was read, before cleaning drops any row.
    """
    last = page.orderBy(*[F.col(c).desc() for c in ("ts", *ids)]).select("ts", *ids).first()
    return None if last is None else tuple(last)


def next_mark(scanned: DataFrame) -> DataFrame:
    """Where the scan after an uncapped one starts: the latest time read."""
    return scanned.agg(F.max("ts").alias("mark"))


def save_cursor(spark: SparkSession, path: str, cursor: tuple, ids: tuple[str, ...], step: int) -> None:
    """Keep the cursor of ``step`` in the state table. Saving a step again replaces it."""
    row = spark.createDataFrame([(*cursor, step)], ["ts", *ids, "step"]).withColumn("step", F.col("step").cast("long"))
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def load_cursor(spark: SparkSession, path: str, ids: tuple[str, ...]) -> tuple | None:
    """The cursor of the last step, None where there is no state yet."""
    from emberlog.operators.documents import exists

    if not exists(spark, path):
        return None
    return tuple(spark.read.parquet(path).orderBy(F.col("step").desc()).select("ts", *ids).first())


def recent_scan(df: DataFrame, now: datetime | str, limit: int | None = None, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The live path's view: the last five minutes, oldest first; a cap is the caller's choice."""
    end = _time(now)
    rows = between(df, end - F.expr(f"INTERVAL {fixed.LIVE_WINDOW}"), end)
    return rows if limit is None else rows.orderBy("ts", *tie_break).limit(limit)


def recent_windows(df: DataFrame, start: datetime | str, end: datetime | str, ids: tuple[str, ...],
                   limit: int | None = None) -> DataFrame:
    """The series of live views: rows with the ``view`` (its end) that shows them.

    A view comes every LIVE_PERIOD, covers the LIVE_WINDOW up to its end, which
    it does not contain, and shows the oldest ``limit`` rows of it, all without
    one. A row is in twenty views at most. Rows are put into panes of one period
    and, with a limit, cut to so many per pane, as no view shows more of one.
    Views are merged from the sizes of their panes: those before a pane leave
    it a number of places, and only rows that get one are copied to the view.
    """
    panes = F.window("ts", fixed.LIVE_PERIOD)
    rows = between(df, start, end).withColumn("_pane", panes).withColumn("_pane", F.col("_pane.start"))
    period, window = (F.expr(f"INTERVAL {x}") for x in (fixed.LIVE_PERIOD, fixed.LIVE_WINDOW))
    ends = F.explode(F.sequence(F.col("_pane") + period, F.col("_pane") + window, period)).alias("view")
    if limit is None:
        return rows.select("*", ends).drop("_pane")
    place = F.row_number().over(W.partitionBy("_pane").orderBy("ts", *ids))
    rows = stage(rows.withColumn("_place", place).filter(F.col("_place") <= limit), "panes")
    sizes = rows.groupBy("_pane").agg(F.count("*").alias("n"))
    before = W.partitionBy("view").orderBy("_pane").rowsBetween(W.unboundedPreceding, -1)
    seats = sizes.select("_pane", "n", ends).withColumn("_left", limit - F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Staged, so that the join has a plain exchange on both sides and a crowded pane can be split.
    seats = stage(seats.filter("_left > 0").select("_pane", "view", "_left"), "seats")
    return rows.join(seats, "_pane").filter(F.col("_place") <= F.col("_left")).drop("_pane", "_place", "_left")
