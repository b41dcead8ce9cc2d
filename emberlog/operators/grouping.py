"""Values looked up by key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(key: Column) -> Column:
    """128 bits that stand for a key of any length; null for a null key."""
    return F.when(key.isNotNull(), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def attach(
    df: DataFrame, key: str | Column, table: DataFrame, size: str = "n", hot_parts: int | None = None
) -> DataFrame:
    """Left-join ``table`` (unique ``key`` column, any values) to ``df`` by key.

    ``size`` names the column of ``table`` that says how many rows of ``df``
    have the key.
    """
    key = F.col(key) if isinstance(key, str) else key
    return _attach(df, hashed(key), table.withColumn("key", hashed(F.col("key"))), size, hot_parts)


def _attach(df: DataFrame, key: Column, table: DataFrame, size: str, hot_parts: int | None) -> DataFrame:
    """``attach`` by hashed keys.

    A key with more than one of ``hot_parts`` shares of the rows (default: one
    shuffle partition's) would make a task longer than the others. Fewer than
    ``hot_parts`` keys can do that, so they are answered from a broadcast,
    where their rows lie; rows without a key stay there too. Only the other
    rows are shuffled, with the hash for a key instead of its text.
    """
    parts = hot_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in table.columns if c != "key"]
    total = table.agg(F.sum(size)).scalar()
    table = table.select("key", F.struct(*values).alias("_found"))
    hot = table.filter(F.col("_found")[size] * parts > total).withColumnRenamed("key", "_hot")
    rows = df.withColumn("_at", key)
    hot_here = F.col("_at") == F.col("_hot")
    answered = rows.join(F.broadcast(hot), hot_here).drop("_hot")
    keyless = rows.filter("_at IS NULL").withColumn("_found", F.lit(None).cast(table.schema["_found"].dataType))
    cold = rows.filter("_at IS NOT NULL").join(F.broadcast(hot.select("_hot")), hot_here, "left_anti")
    looked_up = cold.join(table.withColumnRenamed("key", "_key"), F.col("_at") == F.col("_key"), "left").drop("_key")
    joined = answered.unionByName(keyless).unionByName(looked_up)
    return joined.select(*df.columns, *[F.col("_found")[v].alias(v) for v in values])


def group_counts(df: DataFrame, key: str | Column, size: str = "n") -> DataFrame:
    """Rows per key; combined before the shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("key")).agg(F.count("*").alias(size)).filter("key IS NOT NULL")


def attach_count(df: DataFrame, key: str | Column, name: str, hot_parts: int | None = None) -> DataFrame:
    """Add ``name``: how many rows share this row's ``key`` (null key: 1)."""
    key = hashed(F.col(key) if isinstance(key, str) else key)
    counted = _attach(df, key, group_counts(df, key, "_n"), "_n", hot_parts)
    return counted.withColumn(name, F.coalesce("_n", F.lit(1)).cast("int")).drop("_n")
