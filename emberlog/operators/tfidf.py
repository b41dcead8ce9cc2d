"""Term weights: tokens, vocabulary, TF-IDF."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions.folding import fold

TOKEN = r"([\p{L}\p{N}_]{2,})"
VOCABULARY = "idx int, term string, tf long, df long, idf double"


def tokens(c: Column, strip_accents: bool = True) -> Column:
    """Lower-cased runs of two or more word characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_extract_all(fold(low) if strip_accents else low, F.lit(TOKEN), 1)


def fit_vocabulary(
    df: DataFrame,
    col: str = "message",
    max_terms: int = fixed.MAX_TERMS,
    min_df: int = fixed.MIN_DF,
    strip_accents: bool = True,
) -> DataFrame:
    """The ``max_terms`` most frequent terms found in at least ``min_df`` rows.

    Term and row frequency come from one exchange keyed by term alone: each row
    emits its tokens for the first and its distinct tokens for the second, and
    both are counted before the shuffle, so a term in every row stays cheap.
    Ties in frequency are broken by term.
    """
    rows = df.select(tokens(F.col(col), strip_accents).alias("t"))
    n = rows.agg(F.count("*")).scalar()
    # The outer form of explode: the inner one filters on the array, which
    # would tokenise a second time.
    lists = rows.select(F.posexplode_outer(F.array("t", F.array_distinct("t"))).alias("once", "t"))
    said = lists.select("once", F.explode_outer("t").alias("term")).filter("term IS NOT NULL")
    counts = said.groupBy("term").agg(
        F.count_if(F.col("once") == 0).alias("tf"), F.count_if(F.col("once") == 1).alias("df")
    )
    top = counts.filter(F.col("df") >= min_df).orderBy(F.col("tf").desc(), "term").limit(max_terms)
    # At most max_terms rows from here on.
    listed = top.agg(F.array_sort(F.collect_list(F.struct("term", "tf", "df"))).alias("terms"))
    rows = listed.select(F.posexplode("terms").alias("idx", "x")).select("idx", "x.*")
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    return rows.withColumn("idf", idf)


def nonzero(c: Column) -> Column:
    """A dense array's sparse form: its (place, value) other than 0."""
    return F.filter(F.transform(c, lambda x, i: F.struct(i.alias("place"), x.alias("value"))), lambda s: s["value"] != 0)


def long_form(df: DataFrame, dense: str, *keep: str) -> DataFrame:
    """``keep``, ``place`` and ``value``: one row for each place of the array ``dense`` that is not 0.

    Only those places are unpacked. The outer form of explode: for the inner
    one an inferred filter on the array would work it out a second time.
    """
    return df.select(*keep, F.inline_outer(nonzero(F.col(dense)))).filter("place IS NOT NULL")


@dataclass
class Vectorizer:
    """A fitted vocabulary, small enough to be part of a plan."""

    terms: list[str]
    idf: list[float]
    strip_accents: bool = True

    @classmethod
    def of(cls, vocabulary: DataFrame, strip_accents: bool = True) -> Vectorizer:
        rows = vocabulary.orderBy("idx").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], strip_accents)

    @classmethod
    def load(cls, spark: SparkSession, path: str, strip_accents: bool = True) -> Vectorizer:
        """Read a saved vocabulary; fails when there is none."""
        return cls.of(spark.read.schema(VOCABULARY).parquet(path), strip_accents)

    def add(self, df: DataFrame, col: str = "message", out: str = "tfidf") -> DataFrame:
        """Add the L2-normalised weights as a dense array, in term order.

        Everything happens on the row: no join, no shuffle. Terms outside the
        vocabulary vanish; a row without any known term is all zero.
        """
        if not self.terms:
            return df.withColumn(out, F.array().cast("array<double>"))
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_tokens", outputCol="_counts")
        rows = counter.transform(df.withColumn("_tokens", tokens(F.col(col), self.strip_accents)))
        rows = rows.withColumn("_tf", vector_to_array("_counts"))
        idf = F.array(*[F.lit(x) for x in self.idf])
        weight = F.zip_with("_tf", idf, lambda tf, w: F.when(tf > 0, (F.log(tf) + 1.0) * w).otherwise(0.0))
        rows = rows.withColumn("_w", weight)
        norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w * w))
        rows = rows.withColumn("_norm", norm)
        unit = F.transform("_w", lambda w: F.when(F.col("_norm") > 0, w / F.col("_norm")).otherwise(0.0))
        return rows.withColumn(out, unit).drop("_tokens", "_counts", "_tf", "_w", "_norm")

    def weights(self, df: DataFrame, key: str, col: str) -> DataFrame:
        """Long form: one row per row and known term."""
        terms = F.array(*[F.lit(t) for t in self.terms])
        rows = long_form(self.add(df.select(key, F.col(col)), col), "tfidf", key)
        return rows.select(key, F.element_at(terms, F.col("place") + 1).alias("term"), F.col("value").alias("weight"))
