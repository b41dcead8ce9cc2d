"""Contiguous shards of equal bytes.

Rows are put in order of their id by one range exchange and written to the
shared folder. Totals of the parts, one row each, give every part its start in
the whole; inside a part a running sum does the rest. A row belongs to the
shard in which the middle of its bytes lies, so shards are contiguous in id
order and their sizes differ by at most about one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import col, free_name
from emberlog.session import stage

# Several parts for each task, so that parts dealt by hash even out.
PARTS_PER_TASK = 4
OUTPUT = ("size", "text_crc32", "shard", "slot")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` (from 0) and ``slot``.

    ``size`` is the UTF-8 length of the text plus one for its end; a null text
    has size 1 and no checksum. ``slot`` counts a shard's rows from 0 in id
    order. Null ids come first; rows of one id are ordered by their text's
    checksum and then by their place in the input, and may fall into two
    shards. Columns of the output's names are replaced. An empty table stays
    empty.
    """
    spark = docs.sparkSession
    ordered = _in_order(docs, id_col, text_col)
    rows, part, salt = stage(ordered["rows"], "sharded"), ordered["part"], ordered["salt"]
    before, first = free_name(rows, "_before"), free_name(rows, "_first")
    totals = rows.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    # One row per part: as many as the range exchange had partitions.
    starts = totals.select(
        part, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias(before),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(first))
    whole = totals.agg(F.sum("bytes")).first()[0] or 1
    inside = W.partitionBy(part).orderBy(col(id_col).asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), salt)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    nth = free_name(rows, "_nth")
    placed = rows.join(F.broadcast(starts), part)
    placed = placed.withColumn(nth, F.row_number().over(inside) - 1 + F.col(first))
    middle = F.sum("size").over(running) + F.col(before)
    # Twice the middle of the row, to stay in whole numbers.
    placed = placed.withColumn(before, 2 * middle - F.col("size"))
    placed = placed.withColumn("shard", F.expr(f"CAST((`{before}` * {shards}) DIV (2 * CAST({whole} AS DECIMAL(20, 0))) AS INT)"))
    heads = placed.groupBy("shard").agg(F.min(nth).alias(first))  # one row per shard
    placed = placed.drop(first).join(F.broadcast(heads), "shard").withColumn("slot", F.col(nth) - F.col(first))
    names = [c for c in docs.columns if c.lower() not in OUTPUT]
    return placed.select(*[col(c) for c in names], *OUTPUT)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> dict:
    text = col(text_col)
    made = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(text.cast("binary"))}).drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    part, salt = free_name(made, "_part"), free_name(made, "_salt")
    made = made.withColumn(salt, F.monotonically_increasing_id())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = made.repartitionByRange(
        PARTS_PER_TASK * tasks, col(id_col).asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col(salt))
    return {"rows": rows.withColumn(part, F.spark_partition_id()), "part": part, "salt": salt}


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows of a folder in slot order per file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
