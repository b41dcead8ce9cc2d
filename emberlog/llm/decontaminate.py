"""Benchmark decontamination with spaced seeds.

A seed is a mask laid over consecutive tokens that looks at some positions and
ignores the others, so a substituted token under an ignored position does not
hide a hit. Both masks are laid at every position of the documents and of the
benchmark items, hashed and joined. A hit aligns an item with a document; the
alignment counts when some window of ``WINDOW`` tokens agrees in all but two.
The two masks together hit every such window, wherever its two substitutions
are, so the seeds lose nothing that the verification would have kept.

Everything is DataFrame functions. A document's tokens are 64-bit hashes in an
array; positions are exploded, met with the seeds and cut down to what lies
under the item in one stage, without a shuffle, while the seeds are few enough
to be sent to every task. More seeds are met by a shuffled join of bare keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import col
from emberlog.session import stage

# Positions looked at. Found by trying all: no window of 13 tokens with two
# substitutions, nor of 11 with one, escapes both.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORTEST = 9
WINDOW = 13
# Seeds up to this number (some 60 bytes each) are broadcast, and the items they come from.
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens: runs of letters and digits, lower-cased."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.xxhash64(t))


def allowed(n_tokens: Column) -> Column:
    """Substitutions that a window may have, by the length of the item."""
    return F.when(n_tokens >= WINDOW, 2).when(n_tokens >= 11, 1).otherwise(0)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds a passage.

    Returns ``id_col``, ``item_col``, ``matched`` (most agreeing tokens in a
    window), ``aligned`` (most agreeing tokens of a whole alignment) and
    ``first_word`` (where the item's start lies in the document's tokens, below
    0 if the document begins later in the item). Items of fewer than 13 tokens
    are their own window; those of 11 or 12 may have one substitution and
    shorter ones none. An item of fewer than SHORTEST tokens, a single word say,
    is no passage: only a document that consists of it holds it. Null texts, texts without a token and null items meet
    nothing. Rows of one id count together, null ids too.
    """
    items = benchmark.select(col(item_col).alias("item"), tokens(col(item_text_col)).alias("item_tokens"))
    items = stage(items.filter(F.col("item").isNotNull() & (F.size("item_tokens") > 0)).distinct(), "items")
    seeds = _positions(items.filter(F.size("item_tokens") >= SHORTEST).withColumnRenamed("item_tokens", "toks")).select(
        "seed", "item", F.col("at").alias("item_at"), F.size("toks").alias("n"))
    rows = docs.select(col(id_col).alias("id"), tokens(col(text_col)).alias("toks")).filter(F.size("toks") > 0)
    few = seeds.count() <= BROADCAST_SEEDS
    start = (F.col("at") - F.col("item_at")).alias("start")
    if few:
        found = _positions(rows).join(F.broadcast(seeds), "seed").select("id", "item", "n", start, "toks")
    else:
        bare = _positions(rows).select("id", "at", "seed").join(seeds, "seed")
        places = bare.select("id", "item", "n", start).distinct()
        found = places.join(rows.toDF("row_id", "toks"), F.col("id").eqNullSafe(F.col("row_id")))
    # What the item lies over, cut out at once: a hit must not carry the document.
    lead = F.greatest(-F.col("start"), F.lit(0))
    over = F.slice("toks", F.greatest("start", F.lit(0)) + 1, F.col("n") - lead)
    found = found.select("id", "item", "start", lead.alias("lead"), over.alias("over"))
    pairs = _verified(found.join(F.broadcast(items) if few else items, "item"))
    n = F.size("toks")
    whole = rows.filter(n < SHORTEST).join(items.withColumnRenamed("item_tokens", "toks"), "toks").select(
        "id", "item", F.lit(0).alias("start"), n.alias("n"), n.alias("window"), n.alias("matched"), n.alias("aligned"))
    pairs = pairs.unionByName(whole)
    best = pairs.groupBy("id", "item").agg(
        F.max("matched").alias("matched"), F.max("aligned").alias("aligned"), F.min("start").alias("first_word"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "aligned", "first_word")


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` at every position of ``toks`` under both masks: ``at, seed``."""
    at = lambda i: F.get("toks", F.col("at") + i)
    laid = F.array(*[F.when(F.col("at") + max(mask) < F.size("toks"), F.xxhash64(F.lit(n), *[at(i) for i in mask]))
                     for n, mask in enumerate(MASKS)])
    spots = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("toks") - 1)).alias("at"))
    return spots.select("*", F.explode(laid).alias("seed")).filter(F.col("seed").isNotNull())


def _verified(found: DataFrame) -> DataFrame:
    """Alignments (``start`` of the item in the document) with a window that agrees."""
    n = F.size("item_tokens")
    window = F.least(n, F.lit(WINDOW))
    same = F.transform(F.col("item_tokens"), lambda t, k: F.when(
        t == F.get("over", k - F.col("lead")), 1).otherwise(0))
    agreeing = found.withColumn("same", same)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(1), n - window + 1), lambda s: total(F.slice("same", s, window)))
    judged = agreeing.select("id", "item", "start", n.alias("n"), window.alias("window"), F.array_max(sums).alias("matched"),
                             total(F.col("same")).alias("aligned"))
    return judged.filter(F.col("matched") >= F.col("window") - allowed(F.col("n")))
