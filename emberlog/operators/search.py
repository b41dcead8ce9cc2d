"""Keyword retrieval over documents (BM25, best field wins).

Documents of the same text score alike, and so do questions that ask for the
same terms: both are put into classes, and only classes are compared. Classes of
documents are dealt to blocks, whose postings are kept once; classes of questions
are dealt to blocks too. A task takes a block of questions through some blocks of
documents, one after the other, and keeps each question's best k so far: what
is shuffled and kept grows with the tables, never with questions times documents.

What a question's k-th best document has so far is a bar for all others. Terms
in order of rarity: documents that have only the later ones, whose highest scores
do not add up to the bar, are not looked at. Nothing is dropped that could be
among the best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.operators.grouping import hashed
from emberlog.session import setting, stage

# A block has 2 ** BLOCK_BITS classes of documents and BLOCK_CHARS characters, or fewer, on average.
BLOCK_BITS = 14
BLOCK_CHARS = 16_000_000
# Blocks are no smaller than this for the sake of more tasks.
LEAST = 1024
# Classes of questions in a block, on average.
ASKED = 16_384
# Scoring tasks per core, at least, where there are blocks enough.
TASKS = 2
# Bytes of a block's most frequent terms that are laid out with a place for every document.
SPREAD = 32_000_000
# Postings, and questions times documents, that are summed at once.
VALUES = 500_000
# Places in a list that is short, on average, and documents that are few enough to be looked at one by one.
SHORT, FEW = 200, 100
# Documents, and bytes of their postings, that a task takes together.
TOGETHER, TOGETHER_BYTES = 18_000, 48_000_000
# Terms in an Arrow batch of postings.
TERMS = 20_000
# Scores are compared after rounding to this many places.
PLACES = 6


def words(c: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def question_terms(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """Terms of each question and how often it says them."""
    rows = questions.select(F.col(qid).alias("qid"), F.explode_outer(words(F.col(text))).alias("term"))
    return rows.filter("term IS NOT NULL").groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One run of bytes for the values between each two edges."""
    values = np.ascontiguousarray(values)
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


POSTINGS = pa.schema([
    ("piece", pa.int32()), ("field", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("said", pa.int64()),
    ("docs", pa.binary()), ("tfs", pa.binary())])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: a partition's documents as one block of postings.

    A row has a term of a field, the gaps between the documents that say it, counted in order of ``row``, and how often
    each does. The row of the empty term has the numbers and lengths of the block's documents.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table, piece = pa.Table.from_batches(found).sort_by("row"), TaskContext.get().partitionId()
    del found
    n, rows, copies = len(table), table["row"].to_numpy(), table["copies"].to_numpy()

    def batch(field, term, df, said, docs, tfs):
        of = lambda value, kind: pa.array(np.full(len(term), value), kind)
        return pa.RecordBatch.from_arrays([of(piece, pa.int32()), of(field, pa.int32()), term, pa.array(df), of(said, pa.int64()), docs, tfs], schema=POSTINGS)

    for field in range(len(table.columns) - 2):
        said = table[f"w{field}"].combine_chunks()
        lengths = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int32)
        one = np.array([0, n])
        yield batch(field, pa.array([""]), [int(copies.sum())], int((lengths * copies).sum()), _binary(rows, one), _binary(lengths, one))
        coded = said.flatten().dictionary_encode()
        if not len(coded):
            continue
        pairs = coded.indices.to_numpy().astype(np.int64)
        pairs *= n
        pairs += np.repeat(np.arange(n), lengths)
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        tf = np.diff(np.append(first, len(pairs))).astype(np.int32)
        term, doc = np.divmod(pairs[first], n)
        del pairs, first
        edges = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        gaps = np.diff(doc, prepend=0)
        gaps[edges[:-1]] = doc[edges[:-1]]
        df = np.add.reduceat(copies[doc], edges[:-1])
        docs, tfs = _binary(gaps.astype(np.int32), edges), _binary(tf, edges)
        for at in range(0, len(df), TERMS):
            cut = slice(at, at + TERMS)
            yield batch(field, coded.dictionary[cut], df[cut], 0, docs[cut], tfs[cut])


def _read(files: list[str], columns: list[str]) -> pa.Table:
    """Rows of staged files. Every task reads the blocks it needs from the shared folder; a shuffle would copy them for each."""
    found = []
    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        found.append(pq.read_table(path, filesystem=store, columns=columns, partitioning=None))
    return pa.concat_tables(found).combine_chunks()


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, and how many each row has."""
    whole = column.combine_chunks()
    if not len(whole):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    counts = pc.binary_length(whole).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    offset = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
    return np.frombuffer(whole.buffers()[2], kind, int(counts.sum()), int(offset)), counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Block:
    """Postings of one field of some blocks of documents, for the terms that a block of questions asks for."""

    def __init__(self, tables: list[pa.Table], vocabulary: pa.Array, mean: float):
        heads = pa.concat_tables([t.filter(pc.equal(t["term"], "")) for t in tables])
        self.rows, sizes = _flat(heads["docs"], np.int64)
        lengths, _ = _flat(heads["tfs"], np.int32)
        listed = [t.filter(pc.not_equal(t["term"], "")) for t in tables]
        base = np.repeat(np.cumsum(sizes) - sizes, [len(t) for t in listed])
        table = pa.concat_tables(listed)
        codes = pc.index_in(table["term"], value_set=vocabulary).to_numpy().astype(np.int64)
        order = np.argsort(codes, kind="stable")
        table, codes, base = table.take(pa.array(order)), codes[order], base[order]
        del heads, listed, tables
        gaps, counts = _flat(table["docs"], np.int32)
        tf, _ = _flat(table["tfs"], np.int32)
        sizes = np.bincount(codes, counts, len(vocabulary)).astype(np.int64)
        self.at = np.append(0, np.cumsum(sizes))
        starts = np.cumsum(counts) - counts
        doc = np.cumsum(gaps, dtype=np.int64)
        doc -= np.repeat(doc[starts] - gaps[starts] - base, counts)
        self.doc = doc.astype(np.int32)
        del doc
        k1, b = fixed.BM25_K1, fixed.BM25_B
        long = (k1 * (1 - b + b * lengths / mean))[self.doc]
        long += tf
        self.damped = tf * (k1 + 1)
        self.damped /= long
        del long, gaps, tf, table
        self.most, present = np.zeros(len(vocabulary)), np.flatnonzero(sizes)
        if len(present):
            self.most[present] = np.maximum.reduceat(self.damped, self.at[present])
        n = len(self.rows)
        self.keys = np.repeat(codes * np.int64(n), counts) + self.doc
        frequent = present[sizes[present] * 16 >= n]
        frequent = frequent[np.argsort(-sizes[frequent], kind="stable")][:SPREAD // (8 * max(n, 1))]
        self.spread = np.zeros((len(frequent), n))
        self.spread_at = np.full(len(vocabulary), -1)
        self.spread_at[frequent] = np.arange(len(frequent))
        for place, code in enumerate(frequent):
            here = slice(self.at[code], self.at[code + 1])
            self.spread[place, self.doc[here]] = self.damped[here]

    def look(self, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The damped frequency of each term in each document."""
        place, found = self.spread_at[code], np.zeros(len(code))
        wide = place >= 0
        found[wide] = self.spread[place[wide], doc[wide]]
        rest = np.flatnonzero(~wide)
        if len(rest) and len(self.keys):
            key = code[rest] * np.int64(len(self.rows)) + doc[rest]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[rest] = np.where(self.keys[at] == key, self.damped[at], 0.0)
        return found


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest rounded scores over zero, and of all that equal the least of them."""
    rounded = np.rint(scores * 10**PLACES)
    if len(rounded) > k:
        least = np.partition(rounded, -k)[-k]
        if least > 0:
            return np.flatnonzero(rounded >= least)
    return np.flatnonzero(rounded > 0)


class _Best:
    """Each question's best ``k`` documents so far, in order."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        # What a score must reach to matter; 0 while any score over 0 does. Less than what is best by rounding.
        self.bar = np.zeros(n)

    def add(self, question: int, rows: np.ndarray, scores: np.ndarray) -> None:
        rows, scores = np.append(self.rows[question], rows), np.append(self.scores[question], scores)
        rounded = np.rint(scores * 10**PLACES)
        order = np.lexsort((rows, -rounded))
        order = order[rounded[order] > 0]
        if len(np.unique(rows)) < len(rows):  # by more than one field; the better one counts
            order = order[np.sort(np.unique(rows[order], return_index=True)[1])]
        order = order[:self.k]
        self.rows[question], self.scores[question] = rows[order], scores[order]
        if len(order) == self.k:
            self.bar[question] = max(0.0, (rounded[order[-1]] - 1) / 10**PLACES)


class _Asked:
    """A block of questions: the terms of each by field, the rarest first."""

    def __init__(self, table: pa.Table, field: int, questions: np.ndarray, vocabulary: pa.Array):
        table = table.filter(pc.equal(table["field"], field))
        self.code = pc.index_in(table["term"], value_set=vocabulary).to_numpy()
        self.weight, self.df = table["weight"].to_numpy(), table["df"].to_numpy()
        asked = np.searchsorted(questions, table["question"].to_numpy())
        self.edges = np.searchsorted(asked, np.arange(len(questions) + 1))
        self.asked = asked

    def search(self, block: _Block, best: _Best) -> None:
        if not len(self.code):
            return
        n, begins = len(block.rows), block.at[self.code]
        counts = block.at[self.code + 1] - begins
        # The most that this term and all later ones of the question can add to a score.
        most = np.cumsum((self.weight * block.most[self.code])[::-1])[::-1]
        left = most - np.append(most, 0.0)[self.edges[1:]][self.asked]
        slack = best.bar - 10.0**-PLACES - 1e-12 * most[0]
        # Terms a document must have one of: up to ``middle``. As long as any score matters, all of them.
        free = best.bar <= 0
        until = lambda those: self.edges[:-1] + np.diff(np.append(0, np.cumsum(those))[self.edges])
        middle = until((left >= slack[self.asked]) | free[self.asked])
        # Terms of short lists are summed for many questions at once, the others one by one.
        short = np.minimum(middle, until(self.df * (counts.sum() / self.df.sum()) < SHORT))
        sums = np.append(0, np.cumsum(counts))
        active = np.flatnonzero(sums[middle] - sums[self.edges[:-1]])
        done = np.cumsum((sums[short] - sums[self.edges[:-1]])[active])
        starts, ends, weight, places = begins.tolist(), (begins + counts).tolist(), self.weight.tolist(), block.spread_at[self.code].tolist()
        at, scaled, doc, damped, spread = 0, np.zeros(n), block.doc, block.damped, block.spread
        while at < len(active):
            to = np.searchsorted(done, (done[at - 1] if at else 0) + VALUES, side="right")
            to = max(at + 1, min(int(to), at + max(1, VALUES // n)))
            asked, at = active[at:to], to
            listed = short[asked] - self.edges[asked]
            lists = _ranges(self.edges[asked], listed)
            flat = _ranges(begins[lists], counts[lists])
            # Here and below terms are added one after the other, in their order.
            cells = np.repeat(np.repeat(np.arange(len(asked)) * n, listed), counts[lists]) + doc[flat]
            # Of no values at all it would be whole numbers.
            totals = np.bincount(cells, np.repeat(self.weight[lists], counts[lists]) * damped[flat], len(asked) * n).astype(float, copy=False).reshape(len(asked), n)
            found = []
            for question, row in zip(asked.tolist(), totals):
                i, need, end, bar = int(short[question]), int(middle[question]), int(self.edges[question + 1]), slack[question]
                while True:
                    for i in range(i, need):
                        if places[i] >= 0:
                            row += np.multiply(spread[places[i]], weight[i], out=scaled)
                        elif starts[i] < ends[i]:
                            row[doc[starts[i]:ends[i]]] += weight[i] * damped[starts[i]:ends[i]]
                    if free[question]:
                        here = _first(row, best.k)
                        best.add(question, block.rows[here], row[here])
                        break
                    here = np.flatnonzero(row >= bar - (left[need] if need < end else 0.0))
                    if len(here) <= FEW or need == end:
                        found.append((question, need, here, row[here]))
                        break
                    i, need = need, min(need + 2, end)
            found = [x for x in found if len(x[2])]
            if not found:
                continue
            sizes = [len(x[2]) for x in found]
            own, need = (np.repeat([x[i] for x in found], sizes) for i in range(2))
            own, here, scores = self._finish(block, own, *(np.concatenate([x[i] for x in found]) for i in (2, 3)), need, left, slack)
            order = np.argsort(own, kind="stable")
            own, here, scores = own[order], here[order], scores[order]
            edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist() if len(own) else []
            for start, stop in zip(edges, [*edges[1:], len(own)]):
                best.add(own[start], block.rows[here[start:stop]], scores[start:stop])

    def _finish(
        self, block: _Block, own: np.ndarray, doc: np.ndarray, scores: np.ndarray, at: np.ndarray, left: np.ndarray, slack: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add the terms from ``at`` on, one by one, as long as a document can still reach its question's bar."""
        end, whole = self.edges[own + 1], []
        while len(own):
            ready = at == end
            if ready.any():
                whole.append((own[ready], doc[ready], scores[ready]))
                own, doc, scores, at, end = (x[~ready] for x in (own, doc, scores, at, end))
            scores = scores + self.weight[at] * block.look(self.code[at], doc)
            at = at + 1
            able = scores >= slack[own] - np.where(at < end, left[np.minimum(at, len(left) - 1)], 0.0)
            own, doc, scores, at, end = (x[able] for x in (own, doc, scores, at, end))
        return tuple(np.concatenate(x) for x in zip(*whole)) if whole else (own, doc, scores)


def _together(pieces: list[list[str]], vocabulary: pa.Array, means: list[float]) -> Iterator[list[_Block]]:
    """Postings of the asked terms by field; of a few pieces at once where they are small, which costs less than one by one."""
    wanted, held, n, size = pa.concat_arrays([vocabulary, pa.array([""])]), [], 0, 0

    def made() -> list[_Block]:
        found = [_Block([t.filter(pc.equal(t["field"], f)) for t in held], vocabulary, mean) for f, mean in enumerate(means)]
        held.clear()
        pa.default_memory_pool().release_unused()
        return found

    for files in pieces:
        table = _read(files, ["field", "term", "docs", "tfs"])
        table = table.filter(pc.is_in(table["term"], value_set=wanted)).combine_chunks()
        heads = table.filter(pc.and_(pc.equal(table["term"], ""), pc.equal(table["field"], 0)))
        rows = pc.sum(pc.binary_length(heads["docs"])).as_py() // 8
        if held and (n + rows > TOGETHER or size + table.nbytes > TOGETHER_BYTES):
            yield made()
            n = size = 0
        held.append(table)
        n, size = n + rows, size + table.nbytes
        del table, heads
    if held:
        yield made()


def _score(asked: list[list[str]], docs: list[list[list[str]]], means: list[float], k: int, schema: pa.Schema):
    """For ``mapInArrow`` over the numbers of tasks: the best of a block of questions in some blocks of documents."""

    def best_of(task: int) -> pa.Table:
        block = _read(asked[task // len(docs)], ["question", "field", "term", "df", "weight"])
        block = block.sort_by([("question", "ascending"), ("field", "ascending"), ("df", "ascending"), ("term", "ascending")])
        vocabulary, questions = pc.unique(block["term"]), np.unique(block["question"].to_numpy())
        fields = [_Asked(block, f, questions, vocabulary) for f in range(len(means))]
        best = _Best(len(questions), k)
        for blocks in _together(docs[task % len(docs)], vocabulary, means):
            for terms in fields:
                terms.search(blocks.pop(0), best)
        counts = [len(r) for r in best.rows]
        return pa.table([np.repeat(questions, counts), np.concatenate(best.rows), np.concatenate(best.scores)], schema=schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch[0].to_pylist():
                yield from best_of(task).to_batches(max_chunksize=10_000)

    return score


def _classes(docs: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...], tie_break: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """All rows, numbered in order of ``tie_break``, with the class ``_same`` of their text, without it; and the classes with
    their first ``row``, ``copies`` and ``chars``."""
    said = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    rows = docs.select(*dict.fromkeys((*tie_break, *keep)), hashed(F.struct(*said)).alias("_same"), sum(map(F.length, said), F.lit(0)).alias("_chars"))
    # Ids grow with the partition, and a sorted table's partitions are in order.
    rows = stage(rows.orderBy(*tie_break).select(F.monotonically_increasing_id().alias("_row"), "*"), "search-rows")
    groups = rows.groupBy("_same").agg(F.min("_row").alias("row"), F.count("*").alias("copies"), F.max("_chars").alias("chars"))
    return rows.drop("_chars"), stage(groups, "search-classes")


def _blocks(docs: DataFrame, groups: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Postings of the classes, a block in each file."""
    spark = docs.sparkSession
    size = groups.agg(F.count("*").alias("classes"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    least = min(spark.sparkContext.defaultParallelism, math.ceil(size["classes"] / LEAST))
    n = max(1, least, math.ceil(size["classes"] / 2**BLOCK_BITS), math.ceil(size["chars"] / BLOCK_CHARS))
    said = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    texts = docs.select(hashed(F.struct(*said)).alias("_same"), *[s.alias(f"w{i}") for i, s in enumerate(said)])
    listed = [f"w{i}" for i in range(len(fields))]
    texts = texts.groupBy("_same").agg(*[F.first(w).alias(w) for w in listed])
    numbered = texts.join(groups.select("_same", "row", "copies").hint("merge"), "_same")
    numbered = numbered.select("row", "copies", *[words(F.col(w)).alias(w) for w in listed])
    postings = numbered.mapInArrow(_postings, "piece int, field int, term string, df long, said long, docs binary, tfs binary")
    settings = {
        # A partition is a block; copies go before the shuffle, as they would not by repartition().
        "spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.compression.codec": "zstd"}
    with ExitStack() as held:
        for key, value in settings.items():
            held.enter_context(setting(spark, key, value))
        return stage(postings, "search-postings")


def _files(staged: DataFrame) -> list[list[str]]:
    """The files of each piece."""
    found = staged.select("piece", F.input_file_name().alias("file")).groupBy("piece").agg(F.sort_array(F.collect_set("file")).alias("files"))
    return [r["files"] for r in found.orderBy("piece").collect()]


def _asked(questions: DataFrame, qid: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """``qid, question``: the number of the class; ``question, term, qtf``; and how many classes there are."""
    said = question_terms(questions, qid, text).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("terms"))
    same = F.transform("terms", lambda x: F.concat_ws(" ", x["term"], x["qtf"].cast("string")))
    said = stage(said.withColumn("_same", hashed(F.array_join(same, "\n"))), "search-questions")
    groups = said.groupBy("_same").agg(F.min_by("terms", "qid").alias("terms"))
    groups = stage(groups.select(F.monotonically_increasing_id().alias("question"), "*"), "search-question-classes")
    members = said.select("qid", "_same").join(groups.select("_same", "question"), "_same").drop("_same")
    return members, groups.select("question", F.inline("terms")), groups.count()


def search(
    docs: DataFrame,
    questions: DataFrame,
    qid: str,
    text: str,
    fields: tuple[str, ...] = ("message", "severity"),
    keep: tuple[str, ...] = ("timestamp", "severity", "message"),
    tie_break: tuple[str, ...] = ("timestamp", "doc_id"),
    k: int = fixed.SEARCH_K,
) -> DataFrame:
    """The ``k`` best documents per question: ``qid, rank, score`` and ``keep``.

    Equal scores are in order of ``tie_break``. Questions without a word, or
    whose words no document has, have no row. Questions and documents without
    text match nothing.
    """
    spark, most = docs.sparkSession, max(k, 1)
    rows, groups = _classes(docs, fields, keep, tie_break)
    postings = _blocks(docs, groups, fields)
    askers, asked, n = _asked(questions, qid, text)
    sizes = {r["field"]: r for r in postings.filter("term = ''").groupBy("field").agg(F.sum("df").alias("n"), F.sum("said").alias("said")).collect()}
    total = sizes[0]["n"] if sizes else 0
    met = postings.filter("term <> ''").groupBy("field", "term").agg(F.sum("df").alias("df"))
    weight = F.col("qtf") * F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(met, "term").select("question", "field", "term", "df", weight.alias("weight"))
    asked = stage(asked.repartition(max(1, math.ceil(n / ASKED)), "question").withColumn("piece", F.spark_partition_id()), "search-asked")
    ask_files, doc_files = _files(asked), _files(postings)
    each = max(1, min(len(doc_files), math.ceil(TASKS * spark.sparkContext.defaultParallelism / max(1, len(ask_files)))))
    schema = pa.schema([("question", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])
    means = [sizes[f]["said"] / total or 1.0 if f in sizes else 1.0 for f in range(len(fields))]
    tasks = len(ask_files) * each if doc_files else 0
    scored = _score(ask_files, [doc_files[i::each] for i in range(each)], means, most, schema)
    found = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(scored, "question long, row long, score double")
    found = stage(found.withColumn("score", F.round("score", PLACES)), "search-found")
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "row"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    # Of a class no more than its first k can be shown; cut to so many per task before the shuffle.
    nth = F.row_number().over(W.partitionBy("_same").orderBy("_row"))
    members = rows.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth").join(groups.select("_same", "row"), "_same").drop("_same")
    shown = best.join(members, "row")
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "_row"))
    shown = shown.withColumn("rank", rank).filter(F.col("rank") <= k)
    return askers.join(shown, "question").select("qid", "rank", "score", *keep)


def with_fallback(
    found: DataFrame,
    questions: DataFrame,
    docs: DataFrame,
    qid: str,
    keep: tuple[str, ...] = ("timestamp", "severity", "message"),
    tie_break: tuple[str, ...] = ("timestamp", "doc_id"),
    k: int = fixed.FALLBACK_K,
) -> DataFrame:
    """Give questions that matched nothing the first ``k`` documents."""
    first = docs.orderBy(*tie_break).limit(k)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*tie_break, *keep])))).alias("d")).scalar()
    unmatched = questions.select(F.col(qid).alias("qid")).join(found.select("qid").distinct(), "qid", "left_anti")
    rows = unmatched.select("qid", F.posexplode(listed).alias("rank", "d"))
    rows = rows.select("qid", (F.col("rank") + 1).alias("rank"), F.lit(0.0).alias("score"), *[F.col("d")[c].alias(c) for c in keep])
    return found.unionByName(rows)
