"""Removal of passages that occur before, by repeated-phrase automata.

A window is ``width`` consecutive words of one document. Every word goes that
is covered by a window whose words also start earlier: in a document with a
smaller id, or further up in the same one.

Confirming. Of the ANCHOR_WORDS-word sequences in a window the one with the
least hash is its anchor, so equal windows have equal anchors, and about one
position in seven is one. The windows that share an anchor's place are its
stretch. Only anchors that occur more than once can belong to a repeated
window. If all stretches of such an anchor are equal, the smallest id among
them settles all its windows; the windows of the others are counted one by one,
by 128 bits. So each document learns which of its windows some smaller id has,
and finds its own repetitions by itself.

Locating. The confirmed windows of a batch of documents, joined to passages as
long as they come from one place, are compiled into an Aho-Corasick automaton,
one per shard of SHARD_BYTES of text and SLICE_WORDS of passages, and the
shard's documents are streamed through it whole. A passage found in a document
goes if a smaller id has it, or if it was found in the same document before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import col
from emberlog.session import stage

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
# One automaton serves so much text, and holds passages of so many words.
SHARD_BYTES = 1 << 20
SLICE_WORDS = 200_000
# Texts are hashed in lots of so many bytes, whose arrays stay in a core's cache.
LOT_BYTES = 256 << 10
# A word is three symbols of an alphabet of its own each: nodes stay narrow,
# and no match begins within a word. Holds more words than a slice has.
SYMBOLS = 64
# Rows of one id, or of none, are told apart by this many values of a hash of
# their text, so that no list is made for all of them together.
SALTS = 4096


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_removed``, ``spans``, ``kept_text``.

    Words are runs of anything but space, tab, line feed, vertical tab, form
    feed and carriage return, unchanged. ``spans`` are the removed words as
    (from, to) word numbers, ``to`` excluded; ``kept_text`` is the kept words
    joined by one space. Windows are judged on the input, not on what is left.

    Null and empty texts have no words and an empty ``kept_text``; texts of
    fewer than ``width`` words have no window and stay whole. A null id is
    larger than any other. Rows with one id, or without, are not earlier than
    one another: fully repeated rows all have the same result, in which only
    what a smaller id or the row's own beginning has is gone. Other columns of
    ``docs`` are not looked at. An empty table stays empty.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    told = _told_by_anchor(rows, width)
    known = rows.withColumn("key", _key()).join(told, "key", "left").select("key", "id", "text", "whole", "close")
    known = stage(known, "repeats_anchors")
    seen = _told_by_window(known, width)
    ready = known.join(seen, "key", "left").select("id", "text", "whole", "windows")
    out = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
        T.StructField("kept_text", T.StringType())])
    return ready.mapInArrow(_remover(width), out)


def _key():
    return F.struct("id", "salt")


def _earlier(first: str):
    """Whether ``first`` is an id smaller than the row's own; nulls come last."""
    return F.col(first).isNotNull() & (F.col("id").isNull() | (F.col(first) < F.col("id")))


def _told_by_anchor(rows: DataFrame, width: int) -> DataFrame:
    """By row ``key``: ``whole`` (anchor, first), settled for the whole stretch, and ``close``, anchors to look at by window."""
    made = T.StructType([rows.schema["id"], T.StructField("salt", T.IntegerType()),
                         T.StructField("anchor", T.LongType()), T.StructField("stretch", T.LongType())])
    marks = rows.select("id", "salt", "text").mapInArrow(_marker(width), made)
    repeated = marks.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    # Staged, so that both sides of the join have a plain exchange and a hot anchor can be split.
    repeated = stage(repeated.filter("n > 1 AND first IS NOT NULL").select("anchor", "first", (F.col("low") == F.col("high")).alias("one")),
                     "repeats_anchor_counts")
    found = marks.select("id", "salt", "anchor").join(repeated, "anchor").filter(~F.col("one") | _earlier("first"))
    whole = F.when(F.col("one"), F.struct("anchor", "first"))
    return found.groupBy(_key().alias("key")).agg(
        F.collect_set(whole).alias("whole"), F.collect_set(F.when(~F.col("one"), F.col("anchor"))).alias("close"))


def _told_by_window(known: DataFrame, width: int) -> DataFrame:
    """By row ``key``: ``windows`` (hash, first) that a smaller id has, of the anchors in ``close``."""
    key = known.schema["key"].dataType
    made = T.StructType([key["id"], key["salt"], T.StructField("anchor", T.LongType()), T.StructField("window", T.LongType())])
    some = known.filter(F.size("close") > 0).select("key.id", "key.salt", "text", "close")
    windows = stage(some.mapInArrow(_window_lister(width), made), "repeats_windows")
    firsts = windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    firsts = stage(firsts.filter("n > 1 AND first IS NOT NULL").drop("n"), "repeats_window_counts")
    found = windows.join(firsts, ["anchor", "window"]).filter(_earlier("first"))
    return found.groupBy(_key().alias("key")).agg(F.collect_set(F.struct("window", "first")).alias("windows"))


class Hasher:
    """Hashes of all word sequences of one length, from running sums over the words of many texts.

    A sequence's hash is a polynomial in an odd base, modulo 2^64, of its
    words' hashes.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
            self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def sums(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self._powers(n + 1)
        hashed = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * self.up[:n])])

    def sequences(self, sums: np.ndarray, length: int) -> np.ndarray:
        found = (sums[length:] - sums[:-length]) * self.down[:len(sums) - length]
        return mixed(found)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


class Windows:
    """The windows of a lot of texts, one after the other, and their stretches.

    ``hashes``, ``places`` (the number of a window's first word among all
    ``words``) and ``owners`` (the text it is in) per window; ``anchors``,
    ``stretches`` (hashes) and ``first`` (its first window) per stretch.
    """

    def __init__(self, hasher: Hasher, texts: list[bytes | None], width: int):
        split = [(t or b"").split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words = [w for one in split for w in one]
        counts = np.maximum(self.sizes - width + 1, 0)
        self.owners = np.repeat(np.arange(len(split)), counts)
        self.places = np.arange(len(self.owners)) + np.repeat(self.begins - (np.cumsum(counts) - counts), counts)
        if not len(self.places):
            self.hashes = self.anchors = self.stretches = np.empty(0, np.uint64)
            self.first = np.empty(0, np.int64)
            return
        length = min(ANCHOR_WORDS, width)
        sums = hasher.sums(self.words)
        short = hasher.sequences(sums, length)
        self.hashes = hasher.sequences(sums, width)[self.places]
        # The place travels in the low bits, so that a least value tells where it is; of equals the first.
        mask = np.uint64((1 << 24) - 1)
        least = (short & ~mask) | (np.arange(len(short), dtype=np.uint64) & mask)
        have, want = 1, width - length + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = self.places.astype(np.uint64)
        anchored = (at + ((least[self.places] - at) & mask)).astype(np.int64)
        self.first = np.flatnonzero(np.r_[True, (anchored[1:] != anchored[:-1]) | (self.owners[1:] != self.owners[:-1])])
        after = np.r_[self.first[1:], len(anchored)]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes))])
        shape = (after - self.first).astype(np.uint64) * np.uint64(64) + (anchored[self.first] - self.places[self.first]).astype(np.uint64)
        self.anchors = short[anchored[self.first]]
        self.stretches = mixed((running[after] - running[self.first]) ^ mixed(shape))

    def by_window(self, values: np.ndarray) -> np.ndarray:
        """Values of stretches, for each window of them."""
        return np.repeat(values, np.diff(np.r_[self.first, len(self.hashes)]))


def lots(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(start)


def _once(owners: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the distinct (owner, value)."""
    order = np.lexsort((values, owners))
    new = np.r_[True, (np.diff(owners[order]) != 0) | (values[order][1:] != values[order][:-1])] if len(order) else order
    return order[new]


def _pairs(rows: pa.RecordBatch, owners: np.ndarray, anchors: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    at = pa.array(owners)
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(at), rows.column(1).take(at), pa.array(anchors.view(np.int64)), pa.array(values.view(np.int64))],
        ["id", "salt", "anchor", name])


def _marker(width: int):
    """Distinct (anchor, stretch) of every row; a stretch has one anchor."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows in lots(batch, 2, LOT_BYTES):
                found = Windows(hasher, rows.column(2).to_pylist(), width)
                owners = found.owners[found.first]
                at = _once(owners, found.stretches)
                yield _pairs(rows, owners[at], found.anchors[at], found.stretches[at], "stretch")

    return work


def _window_lister(width: int):
    """Distinct (anchor, window) of every row, of the anchors in its list; a window has one anchor.

    The lists of a lot are taken together: that an anchor is looked at by
    window holds for all rows that have it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows in lots(batch, 2, LOT_BYTES):
                found = Windows(hasher, rows.column(2).to_pylist(), width)
                asked = found.by_window(np.isin(found.anchors, pc.list_flatten(rows.column(3)).to_numpy().view(np.uint64)))
                owners, hashes, anchors = found.owners[asked], found.hashes[asked], found.by_window(found.anchors)[asked]
                at = _once(owners, hashes)
                yield _pairs(rows, owners[at], anchors[at], hashes[at], "window")

    return work


def _remover(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows in lots(batch, 1, SHARD_BYTES):
                yield shard(hasher, rows)

    def shard(hasher, rows):
        ids = rows.column(0).to_pylist()
        found = Windows(hasher, rows.column(1).to_pylist(), width)
        gone = np.zeros(len(found.words), bool)
        for some in slices(confirmed(found, ids, width, rows.column(2), rows.column(3)), width):
            locate(some, ids, found, gone)
        ends = np.r_[found.begins, len(found.words)]
        before = np.r_[0, np.cumsum(gone)]
        # Runs of removed words, which do not go on in the next text.
        breaks = np.zeros(len(gone) + 1, bool)
        breaks[ends] = True
        froms = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | breaks[:-1])) if len(gone) else np.empty(0, np.int64)
        tos = np.flatnonzero(gone & (np.r_[~gone[1:], True] | breaks[1:])) + 1 if len(gone) else froms
        cuts = np.searchsorted(froms, ends)
        own = np.searchsorted(found.begins, froms, "right") - 1
        span = pa.StructArray.from_arrays([pa.array(froms - found.begins[own]), pa.array(tos - found.begins[own])], ["from", "to"])
        kept = []
        for at, n, a, b in zip(found.begins.tolist(), found.sizes.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            left, done = [], at
            for x, y in zip(froms[a:b].tolist(), tos[a:b].tolist()):
                left += found.words[done:x]
                done = y
            kept.append(b" ".join(left + found.words[done:at + n]).decode())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(found.sizes), pa.array(before[ends[1:]] - before[ends[:-1]]),
             pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), span), pa.array(kept, pa.string())],
            [rows.schema.names[0], "n_words", "n_removed", "spans", "kept_text"])

    return work


def _told(lists: pa.Array, name: str, hashes: np.ndarray) -> tuple[np.ndarray, list]:
    """For each hash the number of its smallest id in ``lists`` of (hash, first), -1 without; and those ids.

    The smallest id of an anchor or window is the same in all rows' lists.
    """
    flat = pc.list_flatten(lists)
    if not len(flat):
        return np.full(len(hashes), -1), []
    known, at = np.unique(flat.field(name).to_numpy().view(np.uint64), return_index=True)
    first = flat.field("first").take(pa.array(at)).dictionary_encode()
    spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[spot] == hashes, first.indices.to_numpy()[spot].astype(np.int64), -1), first.dictionary.to_pylist()


def confirmed(found: Windows, ids: list, width: int, whole: pa.Array, windows: pa.Array) -> Iterator[tuple]:
    """Passages of the texts that occur earlier: (words, smallest id that has them); None for the id if it is the text itself."""
    if not len(found.hashes):
        return
    by_anchor, firsts = _told(whole, "anchor", found.anchors)
    by_window, more = _told(windows, "window", found.hashes)
    by_anchor = found.by_window(by_anchor)
    source = np.where(by_anchor >= 0, by_anchor, np.where(by_window >= 0, by_window + len(firsts), -1))
    firsts += more
    # An id's place in the order, so that the comparison is one of numbers; a null id is last.
    order = {x: k for k, x in enumerate(sorted({*firsts, *[i for i in ids if i is not None]}))}
    first_at = np.array([order[x] for x in firsts] + [len(order)])
    own_at = np.array([len(order) if i is None else order[i] for i in ids])
    first = np.where(source >= 0, first_at[source], len(order))
    source = np.where(first < own_at[found.owners], first, -1)
    names = list(order)
    for a, b in runs(source, found.owners, 0):
        yield found.words[found.places[a]:found.places[b] + width], names[source[a]]
    # Windows that start further up in the same text, in runs that do so one after the other.
    by_hash = np.argsort(found.hashes, kind="stable")
    same = (np.diff(found.hashes[by_hash]) == 0) & (np.diff(found.owners[by_hash]) == 0)
    if same.any():
        group = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(by_hash)), 0))
        own = np.full(len(by_hash), -1)
        own[by_hash] = np.where(np.r_[False, same], by_hash[group], -1)
        own[source >= 0] = -1
        for a, b in runs(own, found.owners, 1):
            yield found.words[found.places[a]:found.places[b] + width], None


def runs(values: np.ndarray, owners: np.ndarray, step: int) -> list[tuple[int, int]]:
    """(first, last) of the longest runs without -1, within one owner, in which values rise by ``step``."""
    new = (np.diff(values) != step) | (values[:-1] < 0) | (np.diff(owners) != 0)
    starts = np.flatnonzero(np.r_[True, new])
    ends = np.r_[starts[1:] - 1, len(values) - 1]
    real = values[starts] >= 0
    return list(zip(starts[real].tolist(), ends[real].tolist()))


def slices(passages: Iterable[tuple], width: int) -> Iterator[list[tuple]]:
    """Passages in lots of SLICE_WORDS words; a longer one is cut into parts that overlap by a window less a word."""
    lot, size, step = [], 0, max(1, SLICE_WORDS - width + 1)
    for words, first in passages:
        for at in range(0, max(1, len(words) - width + 1), step):
            part = words[at:at + step + width - 1]
            if lot and size + len(part) > SLICE_WORDS:
                yield lot
                lot, size = [], 0
            lot.append((part, first))
            size += len(part)
    if lot:
        yield lot


def locate(passages: list[tuple], ids: list, found: Windows, gone: np.ndarray) -> None:
    """Mark the words of all texts that one of the passages covers, unless that is where the passage comes from."""
    symbols: dict = {}
    automaton = ahocorasick.Automaton()
    for words, first in passages:
        key = "".join([symbols.get(w) or symbols.setdefault(w, _symbols(len(symbols))) for w in words])
        value = automaton.get(key, None)
        if value is None:
            automaton.add_word(key, [len(words), first])
        elif first is not None and (value[1] is None or first < value[1]):
            value[1] = first
    automaton.make_automaton()
    get = symbols.get
    text = "".join([get(w, "\0\0\0") for w in found.words])
    for own, begin, n in zip(ids, found.begins.tolist(), found.sizes.tolist()):
        met = set()
        for end, value in automaton.iter(text, 3 * begin, 3 * (begin + n)):
            n_words, first = value
            if first is not None and (own is None or first < own) or id(value) in met:
                last = end // 3 + 1
                gone[last - n_words:last] = True
            met.add(id(value))


def _symbols(nth: int) -> str:
    return chr(1 + nth // SYMBOLS ** 2) + chr(1 + SYMBOLS + nth // SYMBOLS % SYMBOLS) + chr(1 + 2 * SYMBOLS + nth % SYMBOLS)
