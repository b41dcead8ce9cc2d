"""Row numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.session import stage

# Parts per task, so that parts of uneven size even out.
PARTS_PER_TASK = 4


def with_row_number(rows: DataFrame, order: tuple[str, ...], out: str = "number", parts: int | None = None) -> DataFrame:
    """``rows`` with a number from 0 by the columns ``order``, which should tell all rows apart.

    One range exchange puts the rows into parts, which are kept. The parts'
    sizes, one row each, give every part its first number; a count inside the
    part does the rest. Nulls come first. An empty table stays empty.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts or PARTS_PER_TASK * tasks, *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per part: as many as the exchange had partitions.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn(out, F.col("_first") + inside - 1).drop("_part", "_first")
