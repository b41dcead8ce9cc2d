"""Which filters of a cleaning recipe do the work, in every order they could be applied.

Each document gets one bit per filter it fails. Whether an equal document with
a smaller id exists is an existential self-join: a left-semi join on the text's
hash, the exact text and the smaller id. Its right side has one row per text,
the smallest id, and only texts whose hash occurs more than once take part.
The ids it finds are put together with those that fail the other filters, and
documents are counted by part and combination of bits. 32 counts of a part
answer all 120 orders: what a step removes are the combinations that hold its
bit and none of an earlier step.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import col
from emberlog.session import stage

FILTERS = "ABCDE"
COMBINATIONS = 1 << len(FILTERS)
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = r"[#$%&*|]"


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document, id and text: ``id, part, bits, n``.

    Bit i is set if filter i of FILTERS removes the document: fewer than
    LEAST_WORDS words; distinct words under DISTINCT_PERCENT of all; A-Z over
    UPPER_PERCENT of the characters; any of MARKS; equal to a document of a
    smaller id. ``n`` counts repeated rows of one id, text and part. Null texts
    are empty, null parts an empty string. A null id is not smaller than any
    and has no smaller one; rows that share an id are not copies of one another.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    others = rows.select("id", "part", "a", "b", _bits("text").alias("bits"), F.lit(1).alias("n"))
    copies = _copies(rows).select("id", "part", "a", "b", F.lit(1 << FILTERS.index("E")).alias("bits"), F.lit(0).alias("n"))
    # A row of its own per id and text: equal rows are summed, the two sources of bits are joined.
    both = others.unionByName(copies).groupBy("id", "part", "a", "b").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return both.select("id", "part", "bits", "n")


def _bits(name: str) -> Column:
    text = F.col(name)
    words = F.filter(F.split(text, "[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > UPPER_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }
    bits = F.lit(0)
    for letter, failed in fails.items():
        bits += F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)
    return bits


def _copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller id has as well."""
    again = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    again = stage(again.filter("n > 1 AND first IS NOT NULL").select("a", "b", F.col("first").alias("least")), "audit_repeated")
    # Ids before texts: only rows above the least id of their hash bring a text along, and of those with it one per text.
    met = rows.join(again, ["a", "b"])
    met = stage(met.filter("id >= least").select("id", "part", "a", "text", "b"), "audit_texts")
    # Staged, so that a text that makes up much of the table can be split over tasks.
    firsts = stage(met.groupBy("a", "text").agg(F.min("id").alias("first")), "audit_firsts").alias("f")
    mine = met.alias("m")
    return mine.join(firsts, (F.col("m.a") == F.col("f.a")) & (F.col("m.text") == F.col("f.text"))
                     & (F.col("f.first") < F.col("m.id")), "left_semi")


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step what the step's filter does there.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (failing its
    filter but gone before), ``unique_fails`` (failing no other filter),
    ``good_lost`` and ``toxic_lost`` (removed here and labelled so), and
    ``shapley``, what the filter removes summed over all orders. ``labels`` has
    ``doc_id, quality, toxic``; an id counts as good or toxic if any of its
    labels says 1. Every part has all its rows, zeros included; an empty table
    has no part and no row.
    """
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = failures(docs, id_col, text_col, part_col).join(stage(said, "audit_labels"), "id", "left")
    flag = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0))
    counted = marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic"))
    return orders(stage(counted, "audit_counts"))


def _steps() -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before."""
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    return [{"filter_order": "".join(order), "step": k + 1, "own": bit[letter], "earlier": sum(bit[x] for x in order[:k])}
            for order in permutations(FILTERS) for k, letter in enumerate(order)]


def orders(counted: DataFrame) -> DataFrame:
    """From ``part, bits, n, good, toxic`` the rows of ``interactions``."""
    of = lambda name: F.map_from_entries(F.collect_list(F.struct("bits", name)))  # noqa: E731  COMBINATIONS entries at most
    parts = counted.groupBy("part").agg(of("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    combos = F.sequence(F.lit(0), F.lit(COMBINATIONS - 1))
    filled = lambda name: F.transform(combos, lambda i: F.coalesce(F.try_element_at(name, i), F.lit(0))).alias(name)
    parts = parts.select("part", filled("n"), filled("good"), filled("toxic"))
    steps = parts.select("*", F.inline(F.from_json(
        F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, own int, earlier int>>")))
    own, earlier = F.col("own"), F.col("earlier")
    fails, gone = (lambda i: i.bitwiseAND(own) != 0), (lambda i: i.bitwiseAND(earlier) != 0)

    def total(name, chosen, weight=lambda i: 1):
        return F.aggregate(combos, F.lit(0).cast("long"), lambda a, i: a + F.when(
            chosen(i), F.element_at(name, i + 1) * weight(i)).otherwise(0))

    here = lambda i: fails(i) & ~gone(i)
    # Of the orders of a combination's filters, each has an equal share in which it comes first.
    shares = lambda i: (F.lit(math.factorial(len(FILTERS))) / F.bit_count(i)).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda i: ~fails(i) & ~gone(i)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda i: fails(i) & gone(i)).alias("redundant"), total("n", lambda i: i == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("n", fails, shares).alias("shapley"))
