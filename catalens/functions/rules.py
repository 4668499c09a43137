"""Predicates and derived measures shared by cleaning and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.functions.parse import trim_spaces

_ASCII_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def null_or_between(value: Column, low, high) -> Column:
    return F.coalesce(value.between(low, high), F.lit(True))


def matches_any(text: Column, patterns) -> Column:
    r"""Case-insensitive search for any pattern; no patterns match nothing.

    A `\b` means an ASCII word edge. Java's own also looks at Unicode letters,
    so for texts with other than ASCII characters the edge is spelled out; all
    other texts take the much faster built-in one.
    """
    if not patterns:
        return F.lit(False)
    built_in = "(?i)(" + "|".join(patterns) + ")"
    spelled = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + _ASCII_EDGE, built_in)
    lowered = F.lower(text)
    if spelled == built_in:
        return lowered.rlike(built_in)
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, lowered.rlike(built_in)).otherwise(lowered.rlike(spelled))


def both_known(revenue: Column, budget: Column) -> Column:
    """TRUE, FALSE, or NULL when one side is NULL and the other is positive."""
    return (revenue > 0) & (budget > 0)


def profit(revenue: Column, budget: Column) -> Column:
    return F.when(both_known(revenue, budget), revenue - budget)


def return_on_budget(revenue: Column, budget: Column, digits: int = 4) -> Column:
    return F.when(both_known(revenue, budget), F.round(revenue / budget, digits))


def profit_percent(revenue: Column, budget: Column) -> Column:
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    pct = F.round((revenue - budget) / budget * 100, 2) + F.lit(0.0)
    return F.when(both_known(revenue, budget), pct)


def decade(year: Column) -> Column:
    return year - year % 10


def first_token(text: Column) -> Column:
    """First entry of a comma-separated list ('' when the list starts with a comma)."""
    return trim_spaces(F.split_part(text, F.lit(","), F.lit(1)))


def credible(votes_floor: int) -> Column:
    """Both money columns are known and enough people voted."""
    return F.col("has_financials") & (F.col("vote_count") >= votes_floor)
