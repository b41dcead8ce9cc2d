"""Severity, intents and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import text


def _first_match(conditions: list[tuple[Column, str]], default: str) -> Column:
    chain = F
    for condition, value in conditions:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def from_norm(norm: Column) -> Column:
    return _first_match([(norm > cut, name) for cut, name in fixed.SEVERITY_BANDS], "INFO")


def from_raw(score: Column, error: Column, login: Column, warning: Column) -> Column:
    """Severity of the older documents: raw score first, then the flags."""
    bands = [(score < cut, name) for cut, name in fixed.SEVERITY_RAW_BANDS]
    return _first_match(bands + [(error == 1, "HIGH"), (login == 1, "MEDIUM"), (warning == 1, "LOW")], "INFO")


def symbol(level: Column) -> Column:
    return text.lookup(level, fixed.SEVERITY_SYMBOLS, fixed.OTHER_SYMBOL)


def arrow(trend: Column) -> Column:
    return text.lookup(trend, fixed.TREND_ARROWS, fixed.OTHER_ARROW)


def intent(question: Column) -> Column:
    """What a question is about; the first matching word list decides."""
    low = F.lower(question)
    rules = []
    for name, words in fixed.INTENTS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        rules.append((hit, name))
    return _first_match(rules, "general")


def is_small_talk(question: Column) -> Column:
    return text.strip(F.lower(question)).isin(fixed.SMALL_TALK)


def document_id(iso: Column, message: Column, *more: Column) -> Column:
    """Key of an anomaly document. ``more`` widens it, e.g. by the host."""
    return F.md5(F.concat(iso, message, *more))
