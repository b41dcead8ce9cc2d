"""Near-duplicates by min-max hashing.

Every permutation of a document's shingles gives two signature values, its
minimum and its maximum, so 64 permutations make a signature of 128 values.
Both values of two documents agree with a probability equal to the similarity
of their sets. Bands of four values are the buckets; two documents of
similarity 0.8 miss each other in all 32 bands once in twenty million times.

Documents with equal sets are one class from the start. Within a bucket nobody
is paired with everybody: all are compared with the one member that meets most
others over all its buckets, the likely original of a group of copies. Links
are confirmed on the full sets, and a bucket is done when its members are in
one component. Members of the other buckets could still be similar to one in
another component. Those pairs are found without a look at their buckets, by
prefixes: with their shingles in order of how many of these sets have them,
rarest first, two sets of similarity t have their first common shingle among
the first (1 - t) n + 1 of either, and after it no fewer shingles than their
intersection needs. Sets that cannot reach even the smallest of those that have
the same shingle leave its group before any pairs are made, as do the members
of a large family of texts that fall just short of the threshold. What remains
is confirmed like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import col, components
from emberlog.session import stage

PERMUTATIONS = 64
BAND_VALUES = 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
# Of 128 signature values, pairs at similarity 0.8 agree in 103 on average with
# a deviation of 4.5; pairs below this number are not worth an exact look. The
# share is scaled for other thresholds.
DEVIATIONS = 7.0
# Up to so many ids are sent to the tasks that look up their texts (some 50
# bytes each); more are joined.
BROADCAST_IDS = 400_000
SHINGLE_WORDS = 5
PERCENT = 80


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z is lower-cased; words are runs of anything but space, tab, line feed,
    vertical tab, form feed and carriage return. A text with fewer words than
    ``width`` has its whole sequence as its one shingle; no words, no shingle.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashed[i:len(words) - width + 1 + i]
        total ^= total >> np.uint64(29)
    return np.unique(total * np.uint64(0xD6E8FEB86659FD93))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240229).integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64)
    return (made[0] << np.uint64(1)) | np.uint64(1), made[1]


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation, in turns."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), 1024):
        hashed = shingles[at:at + 1024, None] * factors
        hashed += offsets
        np.minimum(low, hashed.min(0), out=low)
        np.maximum(high, hashed.max(0), out=high)
    return np.stack([low, high], 1).ravel()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, n_shingles, cls, bands, sig`` per row.

    ``cls`` is a hash of the whole set; ``bands`` one hash per band; ``sig`` one
    byte per signature value. Rows without shingles have none of the three.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    out = T.StructType([rows.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()),
                        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return rows.mapInArrow(_signer(width), out)


def _signer(width: int):
    bands, values = BANDS, BAND_VALUES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _permutations()
        for batch in batches:
            counts, classes, keys, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_hashes(text or b"", width)
                counts.append(len(found))
                if not len(found):
                    classes.append(None)
                    keys.append(None)
                    sigs.append(None)
                    continue
                classes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sig = signature(found, factors, offsets)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for part in sig.reshape(bands, values).T:
                    key = (key ^ part) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
                sig = (sig ^ (sig >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                sigs.append((sig >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "cls", "bands", "sig"])

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked when 100 * intersection >= percent * union of their sets of
    ``width``-word shingles. ``component_id`` is the smallest id that can be
    reached over links, itself included; ``kept`` says that it is the row's own.
    Null and empty texts have no shingles and are linked with nothing. A null id
    gets no component of its own: its component is that of its links, null if it
    has none, and it is kept only in the latter case. Rows with one id are all
    kept or none is. An empty table stays empty.
    """
    signed = stage(signatures(docs, id_col, text_col, width), "signed")
    sets = signed.filter(F.col("cls").isNotNull())
    classes = stage(
        sets.groupBy("cls").agg(F.min(F.struct("n_shingles", "bands", "sig")).alias("one"), F.min("id").alias("id"))
        .select("cls", "id", "one.*"), "classes")
    links = _links(docs.select(col(text_col).cast("binary").alias("text"), col(id_col).alias("id")), classes, width, percent)
    if links is None:
        reached = classes.select("cls", F.col("id").alias("component_id"))
    else:
        groups = components(links).withColumnsRenamed({"node": "cls"})
        grouped = classes.select("cls", "id").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
        reached = stage(grouped.join(least, "component").select("cls", "component_id"), "reached")
    joined = signed.select("id", "n_shingles", "cls").join(reached, "cls", "left")
    own = joined.withColumn("component_id", F.coalesce("component_id", "id"))
    # One id on several rows: the least component that any of them reached.
    several = (own.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
               .filter("n > 1").select("id", "least"))
    own = own.join(several, "id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    return own.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def _links(texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Confirmed links between classes, enough to connect all that are linked."""
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(banded.join(sizes, "bucket"), "members")
    confirm = _Confirm(texts, classes, width, percent)
    links = confirm(_to_leader(members))
    open_members = stage(_unresolved(members, links), "unresolved")
    if open_members.isEmpty():
        return links
    return _joined(links, confirm(_across(confirm.shingles_of(open_members), percent)))


def _joined(links: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    return more if links is None else links if more is None else links.unionByName(more)


def _to_leader(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with its best-connected one."""
    known = members.groupBy("cls").agg(F.sum("size").alias("met"))
    rated = members.join(known, "cls")
    # Staged, so that the join has a plain exchange on both sides and a hot bucket can be split.
    leaders = stage(rated.groupBy("bucket").agg(F.max(F.struct("met", "cls")).alias("leader")), "leaders")
    return (members.join(leaders, "bucket").select(F.col("leader.cls").alias("a"), F.col("cls").alias("b"))
            .filter("a <> b").distinct())


def _unresolved(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of buckets with several components: ``cls, component``."""
    if links is None:
        placed = members.withColumn("component", F.col("cls"))
    else:
        groups = components(links).withColumnRenamed("node", "cls")
        placed = members.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = stage(placed.select("bucket", "cls", "component"), "placed")
    parts = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = stage(parts.filter("low <> high").select("bucket"), "several")
    return placed.join(several, "bucket").select("cls", "component").distinct()


def _across(shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, of all whose sets are similar, found by their first common shingle.

    ``shingles`` has ``cls, component, h`` and ``n``, the size of the set.
    """
    counted = stage(shingles.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1"), "shared_shingles")
    mine = W.partitionBy("cls")
    # Shingles that no other of these sets has come first of all.
    shared = shingles.join(counted, "h").withColumns({
        "common": F.count("*").over(mine), "nth": F.row_number().over(mine.orderBy("f", "h"))})
    at = F.col("n") - F.col("common") + F.col("nth") - 1
    # An intersection can hold this shingle and what comes after it: (n - at) of either set.
    reach = shared.withColumn("reach", F.col("n") - at).filter(100 * F.col("reach") >= percent * F.col("n"))
    reach = stage(reach.select("h", "cls", "component", "n", "reach"), "prefixes")
    enough = lambda overlap, n, m: (100 + percent) * overlap >= percent * (n + m)
    smallest = stage(reach.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("f")).filter("f > 1").drop("f"), "smallest")
    able = stage(reach.join(smallest, "h").filter(enough(F.col("reach"), F.col("n"), F.col("least"))).drop("least"), "able")
    a, b = able.alias("a"), able.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.component") != F.col("b.component"))
                   & enough(F.least("a.reach", "b.reach"), F.col("a.n"), F.col("b.n")))
    return pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


class _Confirm:
    """Keep of pairs of classes (a, b) those whose full sets are similar."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int, percent: int):
        self.texts, self.classes, self.width, self.percent = texts, classes, width, percent
        share = percent / 100
        values = 2 * PERMUTATIONS
        self.least = values * share - DEVIATIONS * (values * share * (1 - share)) ** 0.5

    def __call__(self, pairs: DataFrame) -> DataFrame | None:
        sigs = self.classes.select("cls", "sig", "n_shingles")
        rows = (pairs.join(sigs.toDF("a", "sig_a", "n_a"), "a").join(sigs.toDF("b", "sig_b", "n_b"), "b")
                .filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")))
        alike = F.pandas_udf(_agreeing, "int")
        likely = stage(rows.filter(alike("sig_a", "sig_b") >= self.least).select("a", "b"), "likely")
        if likely.isEmpty():
            return None
        texts = stage(self.texts_of(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "set_texts")
        both = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        linked = F.pandas_udf(_similar(self.width, self.percent), "boolean")
        return stage(both.filter(linked("a", "text_a", "text_b")).select("a", "b"), "confirmed")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """``cls, text`` of the wanted classes."""
        ids = stage(wanted.join(self.classes.select("cls", "id"), "cls"), "wanted")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        found = self.texts.join(ids, self.texts["id"].eqNullSafe(ids["id"])).select("cls", "text")
        same = F.pandas_udf(_set_check(self.width), "boolean")
        return found.filter(same("cls", "text")).dropDuplicates(["cls"])

    def shingles_of(self, members: DataFrame) -> DataFrame:
        """``members`` (cls, component) with every shingle ``h`` of their sets and the sets' sizes ``n``."""
        mine = members.join(self.classes.select("cls", F.col("n_shingles").alias("n")), "cls")
        texts = self.texts_of(members.select("cls")).join(mine, "cls")
        texts = stage(texts.select("cls", "component", "n", "text"), "open_texts")
        return texts.mapInArrow(_exploder(self.width), "cls binary, component binary, n long, h long")


def _exploder(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = shingle_hashes(text, width).view(np.int64)
                at = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(3)], pa.array(found)],
                                                 ["cls", "component", "n", "h"])

    return work


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    left = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((left == right).sum(1).astype(np.int32))


def _set_check(width: int):
    def check(classes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and xxhash.xxh3_128_digest(shingle_hashes(t, width).tobytes()) == c
                          for c, t in zip(classes, texts)], dtype=bool)

    return check


def _similar(width: int, percent: int):
    def similar(keys: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        kept, out = (None, None), []
        for key, a, b in zip(keys, left, right):
            if kept[0] != key:
                kept = key, shingle_hashes(a, width)
            mine, other = kept[1], shingle_hashes(b, width)
            shared = len(mine) + len(other) - len(np.union1d(mine, other))
            out.append(100 * shared >= percent * (len(mine) + len(other) - shared))
        return pd.Series(out, dtype=bool)

    return similar
