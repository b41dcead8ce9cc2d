"""Fingerprints from Lempel-Ziv phrases.

A text is cut into dictionary phrases: from where the last phrase ended, the
shortest run of bytes that is not yet in the dictionary is the next phrase and
enters it. Texts that would help to compress each other have many phrases in
common, so the likeness of two texts is that of their phrase sets, estimated
from the smallest hashes of each.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import col

# Hashes kept per text; the likeness has a standard error of at most 1/16.
KEPT = 64
# Parts of the id order for each task, so that parts dealt by hash even out.
PARTS_PER_TASK = 4


def phrases(data: bytes, known: set[bytes], begin: int = 0, at: int = 0) -> int:
    """Add the phrases of ``data`` to ``known``; the open phrase began at ``begin``.

    Bytes before ``at`` have been parsed already. Returns where the phrase open
    at the end began; it is known already, so nothing of the text is lost.
    """
    add = known.add
    for end in range(at + 1, len(data) + 1):
        piece = data[begin:end]
        if piece not in known:
            add(piece)
            begin = end
    return begin


def sketch(found: set[bytes], kept: int = KEPT) -> np.ndarray:
    """The smallest ``kept`` 32-bit hashes of the phrases, sorted and distinct."""
    hashed = np.unique(np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found)))
    return hashed[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated similarity of the phrase sets, 1 for two empty ones."""
    both = np.union1d(a, b)[:kept]
    if not len(both):
        return 1.0
    return float(np.isin(both, a).astype(int) @ np.isin(both, b).astype(int)) / len(both)


def fingerprint(text: str) -> np.ndarray:
    found: set[bytes] = set()
    phrases(text.encode(), found)
    return sketch(found)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def as_hashes(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` of every whole text; null counts as empty.

    An empty text has the empty fingerprint. A column of that name is replaced.
    """
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(fingerprint(t or "")) for t in texts], dtype=str)

    return docs.withColumn("fingerprint", F.pandas_udf(mark, "string")(col(text_col)))


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edit, and the edit. The part they share is parsed once."""
    changed = edited(text, following)
    shared = text[:len(text) - len(text) // 3].encode()
    one: set[bytes] = set()
    begin = phrases(shared, one)
    two = set(one)
    phrases(text.encode(), one, begin, len(shared))
    phrases(changed.encode(), two, begin, len(shared))
    return sketch(one), sketch(two), changed


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint held against that of an edited text and of the next row.

    Rows are in descending order of id, nulls last, rows of one id in descending
    order of a hash of their text; the last is followed by the first. Returns
    ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Null texts are
    empty. A single row is its own next. An empty table stays empty.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _in_parts(rows, PARTS_PER_TASK * tasks).repartition(tasks, "part").sortWithinPartitions(
        "part", F.desc("donor"), F.col("id").asc_nulls_first(), "h", "text")
    out = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        *[T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]])
    return dealt.select("donor", "id", "text").mapInArrow(_comparer(out.names), out)


def _in_parts(rows: DataFrame, count: int) -> DataFrame:
    """Rows with the part of the order they are in: ``part, donor, id, text, h``.

    A part is walked upwards, so each row's next is the row before it. The last
    row of the part before is added to each part, marked as donor, because it is
    what follows the part's first row; there is one such row per part.
    """
    keys = rows.select("id", "h").repartitionByRange(count, F.col("id").asc_nulls_first(), "h")
    # One row per part, as many as the range exchange had partitions.
    tops = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "h")).alias("top")).select("top.*").collect()
    tops = sorted(((r.id is not None, r.id, r.h) for r in tops), key=lambda k: (k[0], k[1] if k[0] else 0, k[2]))
    if not tops:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("donor"), "id", "text", "h")
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("last_id", rows.schema["id"].dataType),
                         T.StructField("last_h", T.LongType())])
    lasts = rows.sparkSession.createDataFrame([(i, *tops[i - 1][1:]) for i in range(len(tops))], kind)
    donors = rows.join(F.broadcast(lasts), F.col("id").eqNullSafe(F.col("last_id")) & (F.col("h") == F.col("last_h")))
    donors = donors.groupBy("part").agg(F.max(F.struct("id", "text", "h")).alias("row")).select(
        "part", F.lit(True).alias("donor"), "row.*")
    part = F.arrow_udf(_finder(tops[:-1]), "int")("id", "h")
    return donors.unionByName(rows.select(part.alias("part"), F.lit(False).alias("donor"), "id", "text", "h"))


def _finder(bounds: list[tuple]):
    """The number of bounds below a row's key."""
    keys = [(known, value if known else 0, h) for known, value, h in bounds]

    def find(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        pairs = zip(ids.to_pylist(), hashes.to_pylist())
        return pa.array([bisect_left(keys, (i is not None, 0 if i is None else i, h)) for i, h in pairs], pa.int32())

    return find


def _comparer(names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, mark_before = "", None
        for batch in batches:
            ids, columns = [], [[] for _ in names[1:]]
            for donor, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if donor:
                    before, mark_before = text, fingerprint(text)
                    continue
                mark, changed_mark, changed = with_edit(text, before)
                ids.append(key)
                row = (len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(mark), as_text(changed_mark),
                       likeness(mark, changed_mark), likeness(mark, mark_before))
                for column, value in zip(columns, row):
                    column.append(value)
                before, mark_before = text, mark
            kinds = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, *columns], kinds)], names)

    return work
