"""The cleaning chain on the small messy tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalens.bindings.tables import raw_catalog
from catalens.operators import cleaning
from catalens.params import CleanRules
from catalens.schema import CLEAN_SCHEMA

# One row per way to fail, around a title that is there twice.
_HARBOUR = {
    "id": 1, "release_date": "2005-06-01", "revenue": "1000000", "budget": "500000", "runtime": "120",
    "vote_average": "7.5", "adult": "False",
}
MESSY = [
    {**_HARBOUR, "title": "Harbour Lights", "vote_count": "1200", "genres": "Action, Drama", "original_language": "en"},
    {**_HARBOUR, "title": "Harbour Lights, again", "vote_count": "50", "genres": "Action"},
    {"id": 2, "title": "Please UNSUBSCRIBE me", "release_date": "2010-01-01", "vote_count": "0"},
    {"id": 3, "title": "Undated", "release_date": "", "revenue": "5000", "vote_count": "10"},
    {"id": 4, "title": "Too Rich", "release_date": "2012-03-03", "revenue": "4999999999999", "budget": "10"},
]


@pytest.fixture(scope="module")
def cleaned(raw_frame):
    return cleaning.clean(raw_frame(*MESSY)).collect()


def kept(raw_frame, *rows, **limits):
    return sorted(r.id for r in cleaning.clean(raw_frame(*rows), CleanRules(**limits)).collect())


def row(**changes):
    return {**dict(id=1, title="Fine", release_date="2015-01-01", vote_average="6", vote_count="5"), **changes}


def test_schema(raw_frame):
    frame = cleaning.clean(raw_frame(*MESSY))
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in CLEAN_SCHEMA]


def test_junk_rows_are_dropped(cleaned):
    assert [r.title for r in cleaned] == ["Harbour Lights"]


def test_duplicate_with_most_votes_wins(cleaned):
    assert [(r.id, r.vote_count) for r in cleaned] == [(1, 1200)]


def test_derived_columns(cleaned):
    (r,) = cleaned
    assert (r.profit, r.roi, r.profit_pct, r.has_financials) == (500000.0, 2.0, 100.0, True)
    assert (r.primary_genre, r.release_year, r.release_decade, r.release_month) == ("Action", 2005, 2000, 6)
    assert (r.original_language, r.production_countries, r.adult) == ("en", "Unknown", False)


@pytest.mark.parametrize(
    ("title", "votes", "stays"),
    [
        ("Q", "5", False), ("   ", "5", False), (None, "5", False), ("Up", "5", True), ("Q", "50", True),
        ("Q", "49", False), ("Q", None, False), ("", "9999", False), ("Up", None, True),
    ],
)
def test_short_titles(raw_frame, title, votes, stays):
    assert kept(raw_frame, row(title=title, vote_count=votes)) == ([1] if stays else [])


def test_zero_money_has_no_ratios(raw_frame):
    (r,) = cleaning.clean(raw_frame(row(id=9, revenue="0", budget="0"))).collect()
    assert (r.profit, r.roi, r.profit_pct) == (None, None, None)
    assert r.has_financials is False


def test_has_financials_is_three_valued(raw_frame):
    rows = [row(id=1, revenue="5"), row(id=2, revenue="0"), row(id=3, revenue="5", budget="5"), row(id=4)]
    found = {r.id: r.has_financials for r in cleaning.clean(raw_frame(*rows)).collect()}
    assert found == {1: None, 2: False, 3: True, 4: None}


@pytest.mark.parametrize(
    ("column", "inside", "outside"),
    [
        ("revenue", ["0", "3000000000", "x"], ["-1", "3000000001", "nan", "inf"]),
        ("budget", ["0", "3000000000", ""], ["-0.5", "3000000000.5"]),
        ("runtime", ["0", "1000", None], ["-1", "1000.5"]),
        ("vote_average", ["0", "10", "?"], ["-0.1", "10.1"]),
        ("release_date", ["1888-01-01", "2028-12-31"], ["1887-12-31", "2029-01-01", None]),
    ],
)
def test_limits(raw_frame, column, inside, outside):
    rows = [row(id=i, **{column: v}) for i, v in enumerate(inside + outside, start=1)]
    assert kept(raw_frame, *rows) == list(range(1, len(inside) + 1))


def test_gate_runs_before_deduplication(raw_frame):
    rows = [row(vote_count="900", vote_average="99"), row(vote_count="7", title="Lower")]
    assert [r.title for r in cleaning.clean(raw_frame(*rows)).collect()] == ["Lower"]


def test_unknown_votes_come_last_and_ties_are_stable(raw_frame):
    rows = [row(vote_count=None, title="Aa"), row(vote_count="0", title="Zz"), row(vote_count="0", title="Bb")]
    for order in (rows, rows[::-1]):
        frame = raw_frame(*order).repartition(3)
        assert [r.title for r in cleaning.clean(frame).collect()] == ["Bb"]


def test_no_junk_patterns(raw_frame):
    assert kept(raw_frame, row(title="www.x"), junk_patterns=()) == [1]


def test_year_limit_follows_the_calendar():
    assert CleanRules.for_today(2).max_year == dt.date.today().year + 2


def test_diagnostics_and_summary(raw_frame):
    raw = raw_frame(*MESSY, row(id=7, title=None), row(id=8, title=" "))
    found = cleaning.diagnostics(raw)
    assert found.first().asDict() == dict(
        raw_rows=7, missing_title=2, bad_date=1, spam_title=1, over_cap_revenue=1
    )
    summary = cleaning.cleaning_summary(found, cleaning.clean(raw)).first()
    assert (summary.raw_rows, summary.clean_rows, summary.dropped_rows, summary.pct_kept) == (7, 1, 6, 14.29)


def test_summary_of_nothing(raw_frame):
    raw = raw_frame()
    summary = cleaning.cleaning_summary(cleaning.diagnostics(raw), cleaning.clean(raw)).first()
    assert (summary.raw_rows, summary.clean_rows, summary.pct_kept) == (0, 0, 0.0)


def test_every_text_is_parsed_once(raw_frame):
    """No predicate of the gate is pushed below the parsing and parses again."""
    plan = cleaning.clean(raw_frame(*MESSY))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("try_cast" in line for line in filters)


def test_cleaning_a_clean_table_changes_nothing(spark):
    """Unique ids, and every row passes the gate again."""
    cleaned = cleaning.clean(raw_catalog(spark, "/root/testdata/sf0.001")).cache()
    assert cleaned.count() == cleaned.select("id").distinct().count() > 0
    assert cleaned.transform(cleaning.admissible, CleanRules()).count() == cleaned.count()
    cleaned.unpersist()


def test_hot_id_is_pruned_before_the_shuffle(raw_frame):
    """A third of all rows share one id: the plan cuts them in every task first."""
    rows = [row(id=1, vote_count=i % 50, title=f"t{i % 7:02d}") for i in range(300)]
    rows += [row(id=i, title="other") for i in range(2, 602)]
    frame = cleaning.clean(raw_frame(*rows).repartition(6))
    plan = frame._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    assert frame.count() == 601
    best = frame.filter(F.col("id") == 1).first()
    assert (best.vote_count, best.title) == (49, "t00")
