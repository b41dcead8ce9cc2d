"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, folder of tables) and returns rows that are
written to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, language, lines, minhash, packing
from emberlog.llm.common import free_name, table
from emberlog.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin. Learns from labelled rows that are not held out."""
    model = language.fit(docs.filter(~language.held_out()))
    told = language.predict(docs, model)
    return told.filter(F.col("accepted")).select(*docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines. One that had nothing but repeated lines goes."""
    cleaned = lines.deduplicate(docs)
    left = (F.size("dropped_lines") == 0) | F.col("text").rlike(r"\S")
    changed = cleaned.filter(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key that repeated and null ids do not share, in order of the ids."""
    key = free_name(docs, "key")
    made = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    return docs.withColumn(key, made), key


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, and every document without one."""
    keyed, key = _keyed(docs)
    found = stage(minhash.near_duplicates(keyed, key), "near_duplicates")
    gone = found.filter(~F.col("kept")).select(key).distinct()
    left = keyed.join(gone, key, "left_anti")
    repeated = found.groupBy(key).count().filter("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates([key])
    return left.select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    keyed, key = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), key)
    return keyed.join(found.select(key).distinct(), key, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every remaining document goes."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]

# No SQL has zstandard, so the stages are tested one by one against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
