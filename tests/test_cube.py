"""Panels from the cube's cells against the same panels over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from catalens.params import ReportRules, Slice
from catalens.plans import cube, slices

SLICES = (
    Slice(min_votes=0, first_year=None), Slice(), Slice(first_year=1990, last_year=1994, min_votes=50), Slice(languages=("en", "fr"), min_votes=10),
    Slice(genres=("Dra", "War"), min_votes=0, first_year=None), Slice(genres=("Comedy",), languages=("de",), min_votes=100, last_year=1995),
    Slice(first_year=2050), Slice(min_votes=10000),
)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(9)
    tags = ["Drama", "War", "Comedy", "Dragons"]

    def row(i):
        money = rnd.choice([None, 0.0, float(rnd.randint(1, 10**9))])
        return (
            i, f"T{i}", rnd.choice([None, *range(1988, 1998)]), rnd.choice([None, "en", "fr", "de"]),
            rnd.choice([None, "", ", ".join(rnd.sample(tags, rnd.randint(1, 3))), "War,War"]), rnd.choice([None, 0, 9, 10, 49, 50, 99, 100, 700, 20000]),
            rnd.choice([None, 0.0, 10.0, round(rnd.uniform(0, 10), 1)]), rnd.choice([None, 0.0, 90.0, float(rnd.randint(50, 200)), float("nan")]),
            money, None if money is None else money / 3, bool(money), "Drama", 1.0,
        )

    schema = (
        "id long, title string, release_year int, original_language string, genres string, vote_count long, vote_average double, "
        "runtime double, revenue double, budget double, has_financials boolean, primary_genre string, profit double"
    )
    return spark.createDataFrame([row(i) for i in range(2000)], schema)


@pytest.fixture(scope="module")
def cells(spark, table, tmp_path_factory):
    return cube.build(table, f"{tmp_path_factory.mktemp('cube')}/cells")


def listed(frame, digits=4):
    rounded = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes]
    return [tuple(r) for r in frame.select(*rounded).collect()]


PANELS = ("kpis", "per_year", "rating_histogram", "top_genres", "money_trend", "top_rated", "top_grossing")


@pytest.mark.parametrize("panel", PANELS)
def test_panels_equal_those_over_the_rows(table, cells, panel):
    for chosen in SLICES:
        got, expected = getattr(cells, panel)(chosen), getattr(slices, panel)(slices.select(table, chosen))
        assert got.dtypes == expected.dtypes and listed(got) == listed(expected), chosen


def test_domains(table, cells):
    for panel in ("bounds", "genre_domain", "language_domain"):
        assert listed(getattr(cells, panel)()) == listed(getattr(slices, panel)(table))


def test_slices_read_cells_only_and_as_few_as_they_can(spark, cells):
    for panel in PANELS:
        files = getattr(cells, panel)(Slice(genres=("War",))).inputFiles()
        assert files and all(f.startswith(f"file://{cells.folder}/full/") for f in files)
    plain = [f for panel in PANELS[:3] for f in getattr(cells, panel)(Slice()).inputFiles()]
    assert plain and all("/plain/" in f for f in plain)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cells.per_year(Slice(last_year=1990))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(release_year,1980)" in plan and "GreaterThanOrEqual(votes_from,100)" in plan


def test_other_vote_floors_are_refused(spark, table, cells, tmp_path):
    assert not cells.answers(Slice(min_votes=101)) and cells.answers(Slice(min_votes=100))
    for panel in PANELS:
        with pytest.raises(ValueError, match="vote floors"):
            getattr(cells, panel)(Slice(min_votes=101))
    with pytest.raises(ValueError, match="list 15 rows"):
        cells.top_rated(Slice(), n=16)
    other = cube.build(table, f"{tmp_path}/cells", bands=(7, 101), listed=3, limits=ReportRules(financial_votes=20))
    chosen = Slice(min_votes=101)
    expected = slices.money_trend(slices.select(table, chosen), ReportRules(financial_votes=20))
    assert listed(other.money_trend(chosen)) == listed(expected)
    assert listed(other.top_rated(chosen, n=3)) == listed(slices.top_rated(slices.select(table, chosen), n=3))


def test_an_empty_table(spark, table, tmp_path):
    none = cube.build(table.limit(0), f"{tmp_path}/cells")
    assert listed(none.kpis()) == [(0, None, None, None)]
    assert all(getattr(none, panel)().count() == 0 for panel in PANELS[1:])
