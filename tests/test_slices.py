"""Slice and dice."""

from catalens.params import Slice
from catalens.plans import slices


def titles(frame):
    return sorted(r.title for r in frame.collect())


def test_filters(four):
    assert titles(slices.select(four, Slice())) == ["A", "C"]
    assert titles(slices.select(four, Slice(min_votes=0))) == ["A", "B", "C", "D"]
    assert titles(slices.select(four, Slice(first_year=2001, last_year=2009, min_votes=0))) == ["B"]
    assert titles(slices.select(four, Slice(min_votes=0, genres=("Thrill", "Comedy")))) == ["A", "B"]
    assert titles(slices.select(four, Slice(min_votes=0, genres=("drama",)))) == []
    assert titles(slices.select(four, Slice(min_votes=0, languages=("fr",)))) == ["B"]


def test_null_genres_match_no_pick(clean_frame):
    frame = clean_frame(dict(id=1, title="x", release_year=2000, vote_count=100))
    assert titles(slices.select(frame, Slice())) == ["x"]
    assert titles(slices.select(frame, Slice(genres=("Drama",)))) == []


def test_panels(four):
    everything = slices.select(four, Slice(min_votes=0))
    assert tuple(slices.bounds(four).first()) == (2000, 2010)
    assert [r.genre for r in slices.genre_domain(four).collect()] == ["Action", "Comedy", "Drama", "Thriller"]
    assert [r[0] for r in slices.language_domain(four).collect()] == ["en", "fr"]
    assert tuple(slices.kpis(everything).first()) == (4, 6.8, 0.5, 108.0)
    assert [tuple(r) for r in slices.per_year(everything).collect()] == [(2000, 1), (2001, 1), (2010, 2)]
    assert [tuple(r) for r in slices.top_genres(everything, 2).collect()] == [("Action", 2), ("Drama", 2)]
    assert [r.title for r in slices.top_rated(everything).collect()] == ["C", "A", "B", "D"]
    assert [r.title for r in slices.top_grossing(everything).collect()] == ["C", "A"]
    assert [tuple(r) for r in slices.money_trend(everything).collect()] == [(2000, 1e6, 5e5), (2010, 5e8, 2e8)]


def test_histogram_edges(clean_frame):
    ratings = [0.0, 0.24, 0.25, 9.75, 9.99, 10.0, None]
    frame = clean_frame(*[dict(id=i, vote_average=v) for i, v in enumerate(ratings)])
    assert [tuple(r) for r in slices.rating_histogram(frame).collect()] == [
        (1, 0.0, 2), (2, 0.25, 1), (40, 9.75, 3),
    ]


def test_empty_selection(four):
    nothing = slices.select(four, Slice(first_year=2050))
    assert tuple(slices.kpis(nothing).first()) == (0, None, None, None)
    for panel in (slices.per_year, slices.rating_histogram, slices.top_genres, slices.money_trend,
                  slices.top_rated, slices.top_grossing):
        assert panel(nothing).count() == 0
