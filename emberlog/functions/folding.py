"""Accent folding: NFKD with combining marks removed.

Spark has no normalisation function. Folding works letter by letter, so the
letters of the common alphabets that fold to one letter, or to none, are
translated in the JVM; only a text with a character that becomes several, or
one from beyond those alphabets, goes through an Arrow batch.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin, Greek, Cyrillic and their neighbours end here.
TRANSLATED = 0x2000


def fold_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def _tables() -> tuple[str, str, str]:
    """Letters and what they become (those without a counterpart go), and a pattern for all others that change."""
    changed = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if fold_text(c) != c]
    simple = [c for c in changed if ord(c) < TRANSLATED and len(fold_text(c)) <= 1]
    simple.sort(key=lambda c: not fold_text(c))  # what goes comes last
    left = sorted({ord(c) for c in changed} - {ord(c) for c in simple})
    spans: list[list[int]] = []
    for code in left:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    others = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"
    return "".join(simple), "".join(map(fold_text, simple)), others


_FROM, _TO, _OTHERS = _tables()
_BEYOND_ASCII = r"[^\x00-\x7F]"
# Characters of one byte that folding leaves as they are, such as the sharp s.
_BEYOND_STABLE = r"[^\x00-\x7F" + "".join(f"\\x{c:02x}" for c in range(0x80, 0x100) if fold_text(chr(c)) == chr(c)) + "]"


def fold(c: Column) -> Column:
    """The cheap tests come first: most texts are ASCII, and most others are once translated."""
    accented = c.rlike(_BEYOND_ASCII)
    simple = F.when(accented, F.translate(c, _FROM, _TO)).otherwise(c)
    hard = accented & simple.rlike(_BEYOND_STABLE) & simple.rlike(_OTHERS)
    return F.coalesce(_fold_batch(F.when(hard, c)), simple)
