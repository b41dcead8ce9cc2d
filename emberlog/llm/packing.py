"""Best-fit packing into sequences of several permitted lengths.

Texts become pieces of at most the largest length. Pieces are dealt to blocks
of bounded size, which are packed side by side. Within a block they are taken
from the longest to the shortest, each into the open bin where it leaves the
least room. If none has room, a bin is opened in the size that is expected to
cost least per token it will hold, given how much is still to come. In the end
every bin shrinks to the least length that holds its contents. A block is
packed once for each of the lengths as the largest one to open, and the
cheapest of these packings is taken, so the lengths are chosen together.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import col
from emberlog.session import stage

CAPACITIES = (256, 512, 1024, 2048, 4096)
# What a sequence costs besides its tokens, in tokens.
OVERHEAD = 16
# Pieces packed together, on average.
BLOCK_PIECES = 2048


def words(text):
    """Tokens of a text: runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def pieces(docs: DataFrame, id_col: str, text_col: str, largest: int) -> DataFrame:
    """``id, row, piece, start, n_tokens``: a text's words and one end mark, cut to ``largest``.

    ``row`` numbers the rows, so that repeated ids stay apart. Null and empty
    texts are one piece, the end mark.
    """
    rows = docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.size(words(col(text_col))), F.lit(0)).alias("n"))
    rows = stage(rows.withColumn("n", F.greatest("n", F.lit(0)) + 1), "lengths")
    cut = rows.select("id", "row", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest).cast("int"))).alias("piece"))
    start = F.col("piece") * largest
    return cut.select("id", "row", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES,
         overhead: int = OVERHEAD, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Where every piece of every document goes.

    Per piece: ``id_col``, ``piece`` (from 0), ``start`` (its first word in the
    document), ``n_tokens``, ``bin``, ``bin_offset`` (its first token in the
    bin), ``bin_tokens`` and ``capacity`` of the bin. Pieces of a document need
    not share a bin. Every row is packed, null ids and repeated rows included.
    An empty table stays empty.
    """
    sizes = tuple(sorted(set(capacities)))
    cut = pieces(docs, id_col, text_col, sizes[-1])
    blocks = max(1, -(-cut.count() // block_pieces))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[
        T.StructField(n, T.LongType()) for n in ("piece", "start", "n_tokens", "bin", "bin_offset", "bin_tokens", "capacity")]])

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True])
        bins, held = cheapest(rows["n_tokens"].tolist(), sizes, overhead)
        rows["bin"], rows["block"] = bins, rows["block"].astype("int64")
        rows["bin_offset"] = rows.groupby("bin")["n_tokens"].cumsum() - rows["n_tokens"]
        rows["bin_tokens"] = [held[b] for b in bins]
        rows["capacity"] = [fitting(held[b], sizes) for b in bins]
        rows["bin"] += rows["block"] * (1 << 24)
        return rows.rename(columns={"id": id_col})[out.names]

    return dealt.groupBy("block").applyInPandas(block, out)


def fitting(tokens: int, sizes: tuple[int, ...]) -> int:
    """The least permitted length for so many tokens."""
    return sizes[bisect_left(sizes, tokens)]


def cheapest(lengths: list[int], sizes: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """The bin of each length and the tokens of each bin, at least cost."""
    tries = (best_fit(lengths, sizes, limit, overhead) for limit in sizes)
    return min(tries, key=lambda found: sum(fitting(t, sizes) + overhead for t in found[1]))


def best_fit(lengths: list[int], sizes: tuple[int, ...], limit: int, overhead: int) -> tuple[list[int], list[int]]:
    """Best-fit of descending ``lengths``; no bin is opened above ``limit`` unless a piece needs it."""
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    placed, held, room, to_come = [], [], 0, sum(lengths)
    for length in lengths:
        to_come -= length
        at = bisect_left(open_bins, (length, -1))
        if at < len(open_bins):
            left, number = open_bins.pop(at)
            room -= length
        else:
            needed = fitting(length, sizes)
            choice = [s for s in sizes if needed <= s <= max(limit, needed)]
            # What is not going to fit into open bins may fill this one.
            expected = length + max(0, to_come - room)
            left = min(choice, key=lambda s: (s + overhead) / min(s, expected))
            number = len(held)
            held.append(0)
            room += left - length
        left -= length
        placed.append(number)
        held[number] += length
        if left:
            insort(open_bins, (left, number))
    return placed, held


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              end_mark: str = "<end>") -> DataFrame:
    """The texts of the bins: ``bin, capacity, text``. Ids must be unique and not null.

    A bin's pieces are joined in order by spaces; a document's last piece ends
    with ``end_mark``.
    """
    rows = docs.select(col(id_col).alias("id"), F.coalesce(words(col(text_col)), F.array().cast("array<string>")).alias("words"))
    placed = packed.withColumnRenamed(id_col, "id").join(rows, "id")
    mine = F.slice(F.concat("words", F.array(F.lit(end_mark))), (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    part = F.struct("bin_offset", F.array_join(mine, " ").alias("text"))
    bins = placed.groupBy("bin", "capacity").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return bins.select("bin", "capacity", F.array_join(F.col("parts.text"), " ").alias("text"))
