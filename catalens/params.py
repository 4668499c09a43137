"""Thresholds of the cleaning rules, the quality gates and the reports.

All values are plain keyword parameters; the defaults are the published ones.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanRules:
    # Default limits of the cleaning gate.
    min_year: int = 1888
    # An explicit year keeps reruns of the same input identical; see `for_today`.
    max_year: int = 2028
    max_revenue: float = 3_000_000_000.0
    max_budget: float = 3_000_000_000.0
    max_runtime: float = 1000.0
    min_rating: float = 0.0
    max_rating: float = 10.0
    min_title_length: int = 2
    short_title_min_votes: int = 50
    # Patterns that mark a junk title.
    junk_patterns: tuple[str, ...] = (
        "unsubscribe",
        "https?://",
        r"www\.",
        r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    )

    @classmethod
    def for_today(cls, year_offset: int = 2, **limits) -> CleanRules:
        """Rules that admit titles announced up to `year_offset` years ahead."""
        return cls(max_year=dt.date.today().year + year_offset, **limits)


@dataclass(frozen=True)
class QualityRules:
    # Default limits of the two quality gates.
    hard_fail: bool = False
    min_raw_rows: int = 100_000
    min_clean_rows: int = 10_000
    min_rating: float = 0.0
    max_rating: float = 10.0
    required_columns: tuple[str, ...] = (
        "id", "title", "release_date", "revenue", "budget", "vote_average",
        "vote_count",
    )


@dataclass(frozen=True)
class ReportRules:
    # Default floors and list lengths of the reports.
    reliable_votes: int = 50
    top_rated_votes: int = 1000
    financial_votes: int = 100
    well_voted: int = 500
    some_votes: int = 10
    real_budget: float = 100_000.0
    top_n: int = 10
    min_language_rows: int = 15
    # Genres followed by name.
    tracked_genres: tuple[str, ...] = (
        "Action", "Comedy", "Drama", "Horror", "Romance", "Thriller",
        "Science Fiction", "Animation", "Documentary", "Adventure",
    )
    rated_genres: tuple[str, ...] = (
        "Action", "Comedy", "Drama", "Horror", "Romance", "Thriller",
        "Science Fiction", "Animation", "Documentary",
    )
    grossing_genres: tuple[str, ...] = (
        "Action", "Comedy", "Drama", "Horror", "Animation", "Science Fiction",
    )


@dataclass(frozen=True)
class Slice:
    """An interactive selection; None or an empty tuple means 'no filter'."""

    first_year: int | None = 1980
    last_year: int | None = None
    min_votes: int = 100
    genres: tuple[str, ...] = field(default_factory=tuple)
    languages: tuple[str, ...] = field(default_factory=tuple)
