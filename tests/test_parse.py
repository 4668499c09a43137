"""Tolerant casts: the places where Spark's own casts read text differently."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from catalens.functions import parse, rules


def values(spark, build, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string")
    return [r.v for r in frame.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_long(spark):
    cases = {
        "12": 12, "12.7": 13, "12.5": 13, "-12.5": -13, "1e3": 1000, " 5 ": 5, "1_000": 1000,
        "9007199254740993": 2**53 + 1, "abc": None, "": None, "inf": None, "_1": None, "1__0": None,
        "99999999999999999999": None, None: None,
        "12.49999999999999999999": 12, "12.50000000000000000001": 13, "-12.49999999999999999999": -12,
    }
    assert values(spark, parse.parse_long, cases) == list(cases.values())


def test_double(spark):
    cases = {
        "12.5": 12.5, " 5 ": 5.0, ".5": 0.5, "5.": 5.0, "-1e3": -1000.0, "1_000.5": 1000.5,
        "1.5f": None, "1.5d": None, "0x1p3": None, "abc": None, "": None, "1,5": None, None: None,
    }
    assert values(spark, parse.parse_double, cases) == list(cases.values())
    infinite, nan = values(spark, parse.parse_double, ["inf", "NaN"])
    assert infinite == math.inf and math.isnan(nan)


def test_date(spark):
    day = dt.date(2005, 6, 1)
    cases = {
        "2005-06-01": day, "2005-6-1": day, "2005/06/01": day, " 2005-06-01 ": day,
        "2005-06-01 10:00:00": day, "2005-06-01T10:00Z": day, "2005 06 01": day, "2005\\06\\01": day,
        "5-6-1": dt.date(5, 6, 1), "2005-06-01 25:00:00": None, "2005-06-01T": None,
        "2005-06-01 later": None, "2005-06-01x": None, "2005.06.01": None, "2005": None, "2005-06": None, "2005-13-01": None,
        "2005/06-01": None, "not-a-date": None, "": None, None: None,
    }
    assert values(spark, parse.parse_date, cases) == list(cases.values())


def test_trim_strips_every_space_separator_but_not_tabs(spark):
    cases = {"  a b 　": "a b", "\ta\t": "\ta\t", "   ": "", " x ": "x", None: None}
    assert values(spark, parse.trim_spaces, cases) == list(cases.values())
    assert values(spark, parse.blank_to_null, ["  ", " ", " a "]) == [None, None, "a"]


def test_flag(spark):
    assert values(spark, parse.parse_flag, [" True", "1", "t", "False", "", None]) == [
        True, True, True, False, False, None,
    ]


PHONE = (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",)


@pytest.mark.parametrize(
    ("patterns", "text", "found"),
    [
        (("unsubscribe",), "UNSUBSCRIBE now", True),
        (("UNSUBSCRIBE",), "unsubscribe now", True),
        (PHONE, "call 555-123-4567", True),
        (PHONE, "5551234567", True),
        (PHONE, "x5551234567", False),
        (PHONE, "café5551234567", True),  # an accented letter is an ASCII word edge
        ((r"www\.",), "wwwx", False),
        ((), "unsubscribe", False),
    ],
)
def test_junk_patterns(spark, patterns, text, found):
    assert values(spark, lambda c: rules.matches_any(c, patterns), [text]) == [found]


def test_rounding_and_sign_of_zero(spark):
    frame = spark.createDataFrame([(999999.99, 1000000.0)], "revenue double, budget double")
    value = frame.select(rules.profit_percent(F.col("revenue"), F.col("budget"))).first()[0]
    assert value == 0.0 and math.copysign(1, value) == 1.0


def test_decade_is_whole(spark):
    frame = spark.createDataFrame([(1999,), (2000,), (2005,)], "y int")
    decades = frame.select(rules.decade(F.col("y")).alias("d"))
    assert dict(decades.dtypes) == {"d": "int"}
    assert [r.d for r in decades.collect()] == [1990, 2000, 2000]
