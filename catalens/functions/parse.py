"""Tolerant casts: text that cannot be read becomes NULL, never an error.

Spark's own TRY_CAST is stricter than the source data's rules in some places
(fractions as integers, digit separators) and laxer in others (type suffixes,
partial dates). Each helper closes these gaps with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode space separators (category Zs).
SPACES = (
    "              "
    "  　"
)
# All characters that count as white space in Unicode, line breaks and tabs included.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Texts that count as true.
TRUE_TEXTS = ("true", "1", "t")

# A decimal number; digits may be grouped by single underscores.
_NUMBER = (
    r"^\s*[+-]?("
    r"(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN]"
    r")\s*$"
)
# Year, month and day with one kind of separator; a time of day may follow.
_DATE = (
    r"^\s*(\d{1,7}([-/\\ ])\d{1,2}\2\d{1,2})"
    r"(\s*|(T|\s+)([01]?\d|2[0-3]):([0-5]?\d)?(:([0-5]?\d(\.\d*)?)?)?(Z|\s.*|[+-]\d{2}(:?\d{2})?)?)$"
)


def trim_spaces(text: Column) -> Column:
    """Strip every Unicode space separator from both ends (tabs stay)."""
    return F.btrim(text, F.lit(SPACES))


def trim_white_space(text: Column) -> Column:
    """Strip white space of every kind from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trim_spaces(text), F.lit(""))


def _number_text(text: Column) -> Column:
    """The text without digit separators if it has the shape of a number."""
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")))


def parse_double(text: Column) -> Column:
    return _number_text(text).try_cast("double")


def parse_long(text: Column) -> Column:
    """Whole number; fractions and exponents are read and rounded half up.

    Digits beyond the 18th of a fraction are left out first: rounding to 18 digits
    could lift a fraction to one half, leaving digits out cannot.
    """
    number = _number_text(text)
    shortened = F.regexp_replace(number, r"(\.\d{18})\d+", "$1")
    rounded = F.round(shortened.try_cast("decimal(38,18)")).try_cast("bigint")
    return F.coalesce(number.try_cast("bigint"), rounded)


def parse_date(text: Column) -> Column:
    """Year, month and day, all three, split by '-', '/', a backslash or a blank."""
    dashed = F.translate(F.regexp_extract(text, _DATE, 1), "/\\ ", "---")
    # Spark wants four digits of a year.
    return F.coalesce(dashed.try_cast("date"), F.concat(F.lit("000"), dashed).try_cast("date"))


def parse_flag(text: Column) -> Column:
    return F.lower(trim_spaces(text)).isin(*TRUE_TEXTS)
