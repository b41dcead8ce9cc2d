"""Line de-duplication by a deletion-neighbourhood join.

Two lines are copies if one word at most has to be inserted, deleted or
replaced to make one of the other; lines of fewer than ``LEAST_WORDS`` words
have to be equal. A line's neighbourhood is the line and all that is left of it
when one word is deleted. Lines that are one replacement apart share a variant
with the same word deleted; lines that are one insertion apart share the whole
of one and a variant of the other. So lines meet by equal hashes of variants,
and of all that meet only the earliest matters: a line goes if an earlier one
is a copy of it. Groups are reduced to their earliest member before they are
joined back, and no pairs are made within a group.

Equal lines are one from the start. A line can have a copy only if the first
or the second half of its words occurs in another line as well; lines without
such a half make no variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import col, free_name
from emberlog.session import stage

LEAST_WORDS = 8


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines that an earlier line is a copy of.

    Earlier is by id, then by the line's number; lines are what line feeds
    separate. A line goes if any earlier line is its copy, even one that goes
    itself. Lines of white space only always stay. Adds ``n_lines`` and
    ``dropped_lines`` (their numbers from 0, ascending), replacing columns of
    those names; all other columns stay. Null ids come last; rows of one id
    follow each other by a hash of their text, and fully repeated rows are
    treated alike, as one. Null texts stay null and have no lines; an empty
    table stays empty.
    """
    text, made = col(text_col), ("n_lines", "dropped_lines")
    key, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    keyed = docs.withColumn(key, _key(id_col, text_col))
    numbers = _dropped(docs.select(_key(id_col, text_col).alias("key"), text.alias("text")), least_words)
    numbers = numbers.groupBy("key").agg(F.array_sort(F.collect_set("line_no")).alias(gone)).withColumnRenamed("key", key)
    lines = F.split(text, "\n", -1)
    keyed = keyed.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(lines)))
    joined = keyed.join(numbers, key, "left")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    changed = F.when(F.col(gone).isNull(), text).otherwise(left)
    keep = [changed.alias(c) if c == text_col else col(c) for c in docs.columns if c not in made]
    return joined.select(*keep, "n_lines", F.coalesce(gone, F.array().cast("array<int>")).alias("dropped_lines"))


def _key(id_col: str, text_col: str):
    """A row's place in the order, never null itself: nulls last, then id, then text."""
    return F.struct(col(id_col).isNull().alias("last"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h"))


def _dropped(rows: DataFrame, least_words: int) -> DataFrame:
    """Lines that go: ``key, line_no``."""
    lines = (rows.select("key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
             .filter(F.col("line").rlike(r"\S"))
             .withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line"), "spot": F.struct("key", "line_no")}))
    firsts = stage(_distinct_lines(lines, least_words), "lines")
    near = _near_dropped(lines, firsts)
    # Lines that occur again, and lines with an earlier copy.
    again = firsts.filter("n > 1").select("a", "b", "first", F.lit(False).alias("near"))
    told = again.unionByName(near.join(firsts.select("a", "b", "first"), ["a", "b"]).withColumn("near", F.lit(True)))
    # Staged, so that the join has a plain exchange on both sides and a line that
    # makes up much of the corpus can be split over tasks.
    told = stage(told.groupBy("a", "b").agg(F.min("first").alias("first"), F.max("near").alias("near")), "told")
    return (lines.select("a", "b", "key", "line_no", "spot").join(told, ["a", "b"])
            .filter(F.col("near") | (F.col("spot") != F.col("first"))).select("key", "line_no"))


def _words(line):
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _distinct_lines(lines: DataFrame, least_words: int) -> DataFrame:
    """``a, b`` (hashes of the line), ``first`` place, ``n`` occurrences, hashes of ``halves``.

    Of n and m words one edit apart, the first or the last (max(n, m) - 1) // 2
    are the same; a line does not know whether it is the longer one, so both
    lengths count. Lines too short for an edit have no halves.
    """
    n = F.size("words")
    half = lambda length, end: F.xxhash64(F.lit(end), length, F.array_join(
        F.slice("words", 1 if end == "head" else n - length + 1, length), " "))
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    able = n >= least_words
    split = lines.withColumn("words", _words(F.col("line"))).select(
        "a", "b", "spot", *[F.when(able, half(*x)).alias(f"s{i}") for i, x in enumerate(((short, "head"), (short, "tail")))],
        *[F.when(able & (short != long), half(long, end)).alias(f"s{i}") for i, end in ((2, "head"), (3, "tail"))])
    return split.groupBy("a", "b").agg(F.min("spot").alias("first"), F.count("*").alias("n"),
                                       *[F.min(f"s{i}").alias(f"s{i}") for i in range(4)])


def _near_dropped(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Distinct lines (a, b) of which an earlier line is a copy but not equal."""
    halves = firsts.filter("s0 IS NOT NULL").select(
        "a", "b", "first", F.explode(F.array_distinct(F.array("s0", "s1", "s2", "s3"))).alias("half")).filter("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    able = halves.join(shared, "half").select("a", "b", "first").distinct()
    # Numbers that rise with the place; a place is taken by one line alone.
    texts = lines.select("spot", "line").join(able.withColumnRenamed("first", "spot"), "spot")
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fully repeated rows share their spots, so each spot's line is taken once; equal
    # spots are in one range, so that this needs no exchange of its own.
    ordered = texts.repartitionByRange(tasks, "spot").dropDuplicates(["spot"]).sortWithinPartitions("spot")
    ordered = stage(ordered.select(F.monotonically_increasing_id().alias("nth"), "a", "b", "line"), "able_lines")
    variants = ordered.select("nth", "line").mapInArrow(_neighbourhood, "nth long, key long, deleted int")
    met = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    variants = stage(variants.join(met, "key"), "variants")
    whole = variants.filter("deleted < 0").select("key", F.col("nth").alias("whole"))
    part = variants.filter("deleted >= 0")
    earliest = part.groupBy("key", "deleted").agg(F.min("nth").alias("other"))
    replaced = part.join(earliest, ["key", "deleted"]).filter("other < nth").select("nth", "other")
    inserted = part.join(whole, "key").filter("whole <> nth")
    inserted = inserted.select(F.greatest("nth", "whole").alias("nth"), F.least("nth", "whole").alias("other"))
    pairs = replaced.unionByName(inserted).distinct()
    texts = ordered.select("nth", "line")
    both = pairs.join(texts, "nth").join(texts.toDF("other", "earlier"), "other")
    copies = both.filter(F.pandas_udf(_one_edit, "boolean")("line", "earlier")).select("nth").distinct()
    return ordered.join(copies, "nth").select("a", "b").distinct()


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a line (``deleted`` -1) and of its words without each one.

    A sequence's hash is a polynomial in an odd base, modulo 2^64, so that all
    deletions follow from running sums.
    """
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    for batch in batches:
        owners, hashes, places = [], [], []
        for nth, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, split_words(line)), np.uint64)
            n = len(words)
            falling = np.cumprod(np.full(n, inverse, np.uint64)) * np.uint64(base)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * falling)])
            whole, less = (np.full(1, pow(base, max(0, n - k), 1 << 64), np.uint64) for k in (1, 2))
            keys = np.concatenate([whole * sums[-1:], less * sums[:-1] + whole * (sums[-1:] - sums[1:])])
            lengths = np.full(n + 1, n - 1, np.uint64)
            lengths[0] = n
            hashes.append((keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + lengths)
            owners.append(np.full(n + 1, nth))
            places.append(np.arange(-1, n, dtype=np.int32))
        if owners:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(owners)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places))],
                ["nth", "key", "deleted"])


def split_words(line: str) -> list[bytes]:
    """As Spark's split on white space: space, tab, line feed, vertical tab, form feed, carriage return."""
    return line.encode().split()


def one_edit(a: list, b: list) -> bool:
    """Whether two sequences are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= max(len(a), len(b)) - 1


def _one_edit(lines: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([one_edit(split_words(x), split_words(y)) for x, y in zip(lines, others)], dtype=bool)
