"""Text expressions. All of them are built-in functions inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed

# White space in the Unicode sense, including the four separators U+001C..1F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def non_blank(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def has_text(c: Column) -> Column:
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_noise(c: Column) -> Column:
    """Does any marker occur? One pattern, so ``c`` is evaluated once."""
    return c.rlike("|".join(re.escape(marker) for marker in fixed.NOISE_MARKERS))


def strip_prefix_batch(c: Column) -> Column:
    """Drop a syslog prefix with its tag; keep the text when that empties it."""
    return F.coalesce(non_blank(F.regexp_replace(c, fixed.SYSLOG_PREFIX_BATCH, "")), c)


def strip_prefix_live(c: Column) -> Column:
    """Drop stamp and host only, as the live path does."""
    return strip(F.regexp_replace(c, fixed.SYSLOG_PREFIX_LIVE, ""))


def flag(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iu){pattern}").cast("int")


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def uppercase_ratio(c: Column) -> Column:
    upper = F.regexp_count(c, F.lit(r"\p{IsUppercase}"))
    return upper / F.greatest(F.length(c), F.lit(1))


def shorten(c: Column, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(c, 1, n)


def escape_html(c: Column) -> Column:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def template(c: Column) -> Column:
    """Replace the variable parts of a message, so equal shapes compare equal."""
    c = F.regexp_replace(c, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "<ip>")
    c = F.regexp_replace(c, r"\b0[xX][0-9a-fA-F]+\b", "<hex>")
    return F.regexp_replace(c, r"[0-9]+", "<n>")


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))
