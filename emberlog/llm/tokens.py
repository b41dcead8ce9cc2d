"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once, by a public byte-pair vocabulary, and counted by
their length. All that can be asked about lengths follows from the histogram
by sums from its far end: how many documents exceed a limit, how many tokens
remain when each is cut there, and which length a share of the documents keeps
to. Sums run within blocks of lengths and over the blocks' totals, so that no
task holds the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 256


def with_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` of the whole text; 0 for null and empty.

    A column of that name is replaced. The vocabulary file is read on the
    driver and travels with the job (about 1 MB).
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    return docs.withColumn("n_tokens", F.pandas_udf(_counter(ranks), "long")(col(text_col)))


def _counter(ranks: bytes):
    pattern = PATTERN

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        encoder = tiktoken.Encoding("lengths", pat_str=pattern, special_tokens={},
                                    mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
        for texts in batches:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Documents per length: ``length, documents``. Null lengths count as 0."""
    return (lengths.select(F.coalesce(col(length_col), F.lit(0)).cast("long").alias("length"))
            .groupBy("length").agg(F.count("*").alias("documents")))


def context_table(counts: DataFrame) -> DataFrame:
    """One row for every limit at which an answer changes, i.e. every length.

    ``documents`` of just that length; ``within`` and ``over`` the limit;
    ``tokens_within`` of documents that fit; ``tokens_truncated`` if every
    document is cut at the limit; ``tokens`` in all; ``share`` of the documents
    that fit, as a quantile's rank. Between two limits L < M < next, the cut
    total at M is that at L plus (M - L) * over. No rows give no rows.
    """
    rows = counts.withColumn("block", F.floor(F.col("length") / BLOCK))
    rows = rows.withColumn("held", F.col("length") * F.col("documents"))
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("n"), F.sum("held").alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    tails = blocks.select(
        "block", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    whole = blocks.agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    later = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(tails, "block").crossJoin(F.broadcast(whole))  # one row
    rows = rows.withColumns({
        "over": F.col("n_after") + F.coalesce(F.sum("documents").over(later), F.lit(0)),
        "held_over": F.col("t_after") + F.coalesce(F.sum("held").over(later), F.lit(0))})
    within = F.col("all_t") - F.col("held_over")
    return rows.select(
        F.col("length").alias("context_limit"), "documents", (F.col("all_n") - F.col("over")).alias("within"), "over",
        within.alias("tokens_within"), (within + F.col("length") * F.col("over")).alias("tokens_truncated"),
        F.col("all_t").alias("tokens"), ((F.col("all_n") - F.col("over")) / F.col("all_n")).alias("share"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that holds each share of the documents: ``share, length``."""
    asked = table.sparkSession.createDataFrame([(float(s),) for s in shares], "asked double")
    hit = table.join(F.broadcast(asked), F.col("share") >= F.col("asked"))
    return hit.groupBy("asked").agg(F.min("context_limit").alias("length")).withColumnRenamed("asked", "share")


__all__ = ["context_table", "histogram", "quantiles", "with_lengths"]
