"""Language identification by compression.

A text is compressed once per language with a zstandard dictionary made of raw
text in that language; the language whose dictionary gives the fewest bytes
wins. Texts are cut into pieces of ``PIECE`` bytes, all of which count: a
compressor that has seen much of a long text lives on that text alone, and the
dictionaries would no longer tell. A short piece, which no compressor makes
smaller by itself, counts as what it adds to a fixed lead in each language.
Case is folded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import col, free_name, quoted
from emberlog.session import stage

# The classifier is fitted on a bounded sample: of each language the rows with
# the smallest hashes, at most SAMPLE_ROWS of them and of those as many bytes as
# a dictionary holds.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 96 << 10
# A task has the compressors of so many languages at a time; there may be any number of languages.
BLOCK = 64
PIECE = 2048
SHORT, LEAD = 512, 1024
LEVEL = 6
# Texts whose runner-up is closer than this share of its own size are rejected.
MARGIN = 0.004


@dataclass(frozen=True)
class LanguageModel:
    """Raw text per language, in the order of the languages' names.

    The last ``LEAD`` bytes are the lead, the rest is the dictionary.
    """

    dictionaries: dict[str, bytes]
    level: int = LEVEL
    piece: int = PIECE


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Learn one dictionary per value of ``lang_col``.

    Rows without text, language or a single letter teach nothing. No rows give
    a model without languages, which predicts ``und`` for everything.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = stage(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    # Rows are thinned out by their hash before they are ranked, to some four
    # times what is kept, so that what meets in one place does not grow.
    place = F.xxhash64("id", "text")
    share = 4.0 * sample_rows / F.col("rows")
    rows = rows.join(counts, "lang").filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    order = W.partitionBy("lang").orderBy(place, "id", "text")
    picked = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample_rows)
    sizes = W.partitionBy("lang").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = picked.withColumn("so_far", F.sum(F.octet_length("text")).over(sizes))
    picked = picked.filter(F.col("so_far") - F.octet_length("text") < dictionary_bytes)
    found: dict[str, list[bytes]] = {}
    for row in picked.select("lang", "text").orderBy("lang", "nth").toLocalIterator():
        found.setdefault(row.lang, []).append(row.text.lower().encode())
    return LanguageModel({k: b"\n".join(v)[:dictionary_bytes] for k, v in sorted(found.items())})


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted``.

    ``score`` is the margin between the two smallest sizes as a share of the
    second (0 to 1; 1 if only one language is known). ``accepted`` is false
    where the margin is narrow. Null texts and texts without a letter are
    ``und``, score 0, not accepted. Columns of those names are replaced.
    """
    made = free_name(docs, "_prediction")
    kind = "struct<lang_pred:string,score:double>"
    rated = docs.withColumn(made, F.pandas_udf(_rater(model), kind)(col(text_col)))
    keep = [col(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    field = lambda name: F.col(f"{quoted(made)}.{name}")
    return rated.select(
        *keep, field("lang_pred").alias("lang_pred"), field("score").alias("score"),
        ((field("lang_pred") != "und") & (field("score") >= margin)).alias("accepted"))


def _rater(model: LanguageModel):
    names, level, piece = list(model.dictionaries), model.level, model.piece
    contents, short, lead = list(model.dictionaries.values()), SHORT, LEAD

    def sizer(raw):
        known = zstandard.ZstdCompressionDict(raw[:-lead], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        pack = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False).compress
        before = raw[-lead:]
        alone = len(pack(before))
        return lambda part: len(pack(part)) if len(part) >= short else len(pack(before + part)) - alone

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        blocks = [range(at, min(at + BLOCK, len(contents))) for at in range(0, len(contents), BLOCK)]
        made = [sizer(raw) for raw in contents] if len(blocks) == 1 else None
        has_letter = regex.compile(r"\p{L}")
        for texts in batches:
            rated = [[] if text is None or not contents or not has_letter.search(text) else
                     [data[i:i + piece] for data in [text.lower().encode()] for i in range(0, len(data), piece)] for text in texts]
            # The two smallest sizes so far, with the first one's language.
            best = [[None, None, None] for _ in rated]
            for block in blocks:
                sizers = made or [sizer(contents[i]) for i in block]
                for parts, kept in zip(rated, best):
                    if parts:
                        for i, size in zip(block, sizers):
                            n = max(0, sum(map(size, parts)))
                            if kept[0] is None or n < kept[0]:
                                kept[:] = n, kept[0], i
                            elif kept[1] is None or n < kept[1]:
                                kept[1] = n
            yield pd.DataFrame({
                "lang_pred": ["und" if i is None else names[i] for _, _, i in best],
                "score": [0.0 if i is None else 1.0 if other is None else (other - n) / max(1, other) for n, other, i in best]})

    return rate


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that no model learns from."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


__all__ = ["LanguageModel", "fit", "held_out", "predict"]
