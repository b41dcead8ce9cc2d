"""The filter audit, against filters applied one after the other in all orders."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from emberlog.llm import audit

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        failed = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and least[text] < i}
        docs.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d[1:] for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), sum(letter in d[0] for d in mine) - len(here), sum(d[0] == {letter} for d in mine),
                    sum(d[1] for d in here), sum(d[2] for d in here), letter]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


def found(docs, labels):
    rows = audit.interactions(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n):
    pick = random.Random(seed)
    texts = []
    for k in range(n):
        words = [f"{'A' if pick.random() < 0.2 else 'a'}{pick.randrange(60)}" for _ in range(pick.choice([10, 49, 50, 80]))]
        texts.append(pick.choice([" ", "\n", "\x1f "]).join(words) + pick.choice(["", "", " #", "|"]))
    return [(k, pick.choice(texts[:n // 3]), pick.choice(["x", "y", "", None, "x y"])) for k in pick.sample(range(5 * n), n)]


def test_random_documents(spark):
    rows = made(1, 300)
    labels = [(i, random.Random(i).randrange(2), random.Random(i + 1).randrange(2)) for i, *_ in rows[::2]]
    assert found(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)) == brute(rows, labels)


def test_dirty_rows(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None, None), (2, "", "a"), (None, "", "a"), (3, " \n ", "a"), (4, long, "b"), (5, long, "b"), (5, long, "b"), (5, long, "c"), (None, long, "b"),
            (6, "É" * 99 + "ABCDE", "b"), (7, "É" * 95 + "ABCDE", "b"), (2, "other", "a"), (1, "", "z")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    said = spark.createDataFrame(labels, LABELS)
    assert found(docs, said) == brute(rows, labels)
    extra = docs
    for name in ("id", "part", "a", "b", "bits", "n", "first", "least", "good", "toxic", "quality", "own", "step"):
        extra = extra.withColumn(name, F.lit("mine"))
    assert found(extra, said.withColumn("id", F.lit(0)).withColumn("part", F.lit("mine"))) == brute(rows, labels)
    assert found(docs, said.limit(0)) == brute(rows, [])
    assert found(docs.limit(0), said) == {}


def test_a_text_that_is_most_of_the_table(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}", "x") for k in range(3000)]
    got = found(spark.createDataFrame(rows, DOCS).repartition(8), spark.createDataFrame([(5, 0, 1)], LABELS))
    assert got["x", "EABCD", 1][:2] == [1001, 1999] and got["x", "EABCD", 1][5] == 1
