"""Removal of passages that occur before, against a plain search of all windows."""

import hashlib
import random

import ahocorasick
import pytest
from pyspark.sql import functions as F

from emberlog.llm import queries, repeats

DOCS = "doc_id long, text string"


def brute(rows, width):
    """(id, n_words, removed word numbers, kept text) of every row, in the rows' order."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for s in range(len(words) - width + 1):
            window = tuple(words[s:s + width])
            if i is not None:
                least[window] = min(i, least.get(window, i))
    out = []
    for i, words in split:
        gone, seen = set(), set()
        for s in range(len(words) - width + 1):
            window = tuple(words[s:s + width])
            first = least.get(window)
            if window in seen or first is not None and (i is None or first < i):
                gone |= set(range(s, s + width))
            seen.add(window)
        out.append((i, len(words), sorted(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def found(df, width):
    return [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s["from"], s["to"])], r.kept_text)
            for r in repeats.remove_repeats(df, width=width).collect()]


def compare(spark, rows, width, parts=3):
    got = found(spark.createDataFrame(rows, DOCS).repartition(parts), width)
    assert sorted(got, key=str) == sorted(brute(rows, width), key=str)
    return got


def words(pick, n, kinds):
    return [f"w{pick.randrange(kinds)}" for _ in range(n)]


@pytest.mark.parametrize("width", [4, 9, 20])
def test_passages_shared_in_part_and_whole(spark, width):
    pick = random.Random(width)
    passages = [words(pick, pick.randrange(width, 5 * width), 10 ** 6) for _ in range(8)]
    rows = []
    for k in range(150):
        made = []
        for _ in range(pick.randrange(0, 5)):
            p = pick.choice(passages)
            a = pick.randrange(len(p))
            made += words(pick, pick.randrange(0, 8), 10 ** 6) + (p if pick.random() < 0.4 else p[a:a + pick.randrange(2 * width)])
            if pick.random() < 0.3 and made:
                made[pick.randrange(len(made))] = "edited"
        rows.append((pick.randrange(10 ** 6), pick.choice([" ", "\n", " \t "]).join(made)))
    got = compare(spark, rows, width)
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_few_words_and_rhythms(spark):
    """Texts of two or three words' kinds, where everything repeats everywhere."""
    pick = random.Random(4)
    rows = [(k, " ".join(words(pick, pick.randrange(60), pick.choice([1, 2, 3])))) for k in range(80)]
    rows += [(100 + k, "ab " * k) for k in range(0, 50, 7)] + [(200, "a b c " * 30), (201, "x " * 500), (202, "x " * 19)]
    compare(spark, rows, 5)
    compare(spark, rows, 20)


def test_dirty_rows(spark):
    long = " ".join(words(random.Random(1), 30_000, 3000))
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, None), (None, a), (2, ""), (3, " \n\t "), (4, a + " x"), (4, a + " x"), (4, a), (5, a), (None, b), (None, b), (None, None),
            (6, long), (7, "start " + long[:50_000]), (8, "é 😀 ÄÖ ende da hier é 😀 ÄÖ ende da hier"), (9, "É 😀 ÄÖ ende da hier")]
    for k in (1, 7):
        compare(spark, rows, 5, k)
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame(rows, DOCS)
    for name in ("id", "key", "salt", "anchor", "whole", "close", "windows", "n_words", "spans", "kept_text", "first"):
        extra = extra.withColumn(name, F.lit("mine"))
    assert sorted(found(extra, 5), key=str) == sorted(brute(rows, 5), key=str)


def test_one_anchor_in_many_surroundings(spark):
    """A template: the same twelve words between others in every document."""
    pick = random.Random(2)
    core = words(pick, 12, 10 ** 6)
    rows = [(k, " ".join(words(pick, 15, 40) + core + words(pick, 15, 40))) for k in range(600)]
    compare(spark, rows, 20)
    some = [words(pick, 6, 10 ** 6) for _ in range(9)]
    rows = [(k, " ".join(pick.choice(some) + core + pick.choice(some))) for k in range(400)]
    compare(spark, rows, 20)


def test_text_ids(spark):
    rows = [("b", "one two three four five"), ("a", "zero one two three four five"), (None, "two three four five six")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), width=4).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == [
        ("None", "six"), ("a", "zero one two three four five"), ("b", "")]


def test_slices_overlap(monkeypatch):
    """Long passages are cut so that no window is lost, and no lot holds more words than it may."""
    monkeypatch.setattr(repeats, "SLICE_WORDS", 50)
    text = [str(k).encode() for k in range(400)]
    lots = list(repeats.slices([(text, 1), (text[:30], 2)], 20))
    windows = {tuple(p[s:s + 20]) for lot in lots for p, _ in lot for s in range(len(p) - 19)}
    assert windows == {tuple(text[s:s + 20]) for s in range(381)}
    assert all(sum(len(p) for p, _ in lot) <= 50 for lot in lots)


def test_symbols_of_words_do_not_run_into_each_other():
    made = [repeats._symbols(k) for k in range(repeats.SLICE_WORDS)]
    assert len(set(made)) == len(made)
    assert not {m[0] for m in made} & {m[1] for m in made} and not {m[1] for m in made} & {m[2] for m in made}
    automaton = ahocorasick.Automaton()
    automaton.add_word(made[5] + made[7], 1)
    automaton.make_automaton()
    assert [e for e, _ in automaton.iter(made[7] + made[5] + made[7] + made[5])] == [8]


def test_query_on_whole_table(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_substring_dedup(spark, folder).collect()}
    assert got == {i: (n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 20)}
