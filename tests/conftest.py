"""Shared Spark session and the small frames used across the tests."""

from __future__ import annotations

import datetime as dt

import pytest

from catalens.params import QualityRules, ReportRules
from catalens.schema import ANALYSIS_COLUMNS, CLEAN_SCHEMA, RAW_COLUMNS, text_schema
from catalens.session import session


@pytest.fixture(scope="session")
def spark():
    return session(cpus=4)


@pytest.fixture(scope="session")
def raw_frame(spark):
    """Build a raw text frame from dicts; absent columns are NULL."""

    def build(*rows):
        data = [[None if r.get(c) is None else str(r[c]) for c in RAW_COLUMNS] for r in rows]
        return spark.createDataFrame(data, text_schema())

    return build


@pytest.fixture(scope="session")
def clean_frame(spark):
    """Build a frame in the clean layout from dicts; absent columns are NULL."""

    def build(*rows, columns=ANALYSIS_COLUMNS):
        schema = type(CLEAN_SCHEMA)([CLEAN_SCHEMA[c] for c in columns])
        return spark.createDataFrame([[r.get(c) for c in columns] for r in rows], schema)

    return build


FOUR_ROWS = [
    dict(
        id=1, title="A", status="Released", release_date=dt.date(2000, 5, 1), release_year=2000,
        release_decade=2000, release_month=5, revenue=1e6, budget=5e5, runtime=95.0, vote_average=7.5,
        vote_count=1500, popularity=10.0, original_language="en", genres="Action, Thriller",
        primary_genre="Action", profit=5e5, roi=2.0, profit_pct=100.0, has_financials=True,
    ),
    dict(
        id=2, title="B", status="Released", release_date=dt.date(2001, 7, 3), release_year=2001,
        release_decade=2000, release_month=7, revenue=0.0, budget=0.0, runtime=120.0, vote_average=6.0,
        vote_count=20, popularity=2.0, original_language="fr", genres="Comedy",
        primary_genre="Comedy", has_financials=False,
    ),
    dict(
        id=3, title="C", status="Released", release_date=dt.date(2010, 1, 10), release_year=2010,
        release_decade=2010, release_month=1, revenue=5e8, budget=2e8, runtime=150.0, vote_average=8.2,
        vote_count=9000, popularity=55.0, original_language="en", genres="Action, Drama",
        primary_genre="Action", profit=3e8, roi=2.5, profit_pct=150.0, has_financials=True,
    ),
    dict(
        id=4, title="D", status="Released", release_date=dt.date(2010, 12, 25), release_year=2010,
        release_decade=2010, release_month=12, revenue=2e6, budget=1e6, runtime=88.0, vote_average=5.5,
        vote_count=80, popularity=8.0, original_language="en", genres="Drama",
        primary_genre="Drama", profit=1e6, roi=2.0, profit_pct=100.0, has_financials=True,
    ),
]


@pytest.fixture
def four_rows():
    return [dict(r) for r in FOUR_ROWS]


@pytest.fixture
def four(clean_frame, four_rows):
    return clean_frame(*four_rows)


@pytest.fixture
def low_gates():
    return QualityRules(min_raw_rows=1, min_clean_rows=1)


@pytest.fixture
def limits():
    return ReportRules()
