"""Fixed table layouts of the raw, clean and analysis frames."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the raw text file.
RAW_COLUMNS = (
    "id", "title", "vote_average", "vote_count", "status", "release_date",
    "revenue", "runtime", "adult", "backdrop_path", "budget", "homepage",
    "imdb_id", "original_language", "original_title", "overview", "popularity",
    "poster_path", "tagline", "genres", "production_companies",
    "production_countries", "spoken_languages", "keywords",
)

# Names, order and types of the clean table.
_CLEAN_TYPES = (
    ("id", T.LongType()),
    ("title", T.StringType()),
    ("original_title", T.StringType()),
    ("status", T.StringType()),
    ("release_date", T.DateType()),
    ("release_year", T.IntegerType()),
    ("release_decade", T.IntegerType()),
    ("release_month", T.IntegerType()),
    ("revenue", T.DoubleType()),
    ("budget", T.DoubleType()),
    ("runtime", T.DoubleType()),
    ("vote_average", T.DoubleType()),
    ("vote_count", T.LongType()),
    ("popularity", T.DoubleType()),
    ("adult", T.BooleanType()),
    ("original_language", T.StringType()),
    ("genres", T.StringType()),
    ("primary_genre", T.StringType()),
    ("production_countries", T.StringType()),
    ("spoken_languages", T.StringType()),
    ("keywords", T.StringType()),
    ("overview", T.StringType()),
    ("profit", T.DoubleType()),
    ("roi", T.DoubleType()),
    ("profit_pct", T.DoubleType()),
    ("has_financials", T.BooleanType()),
)
CLEAN_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _CLEAN_TYPES])
CLEAN_COLUMNS = tuple(CLEAN_SCHEMA.names)

# The columns the summary reports read (long texts are left out).
ANALYSIS_COLUMNS = (
    "id", "title", "status", "release_date", "release_year", "release_decade",
    "release_month", "revenue", "budget", "runtime", "vote_average",
    "vote_count", "popularity", "original_language", "genres", "primary_genre",
    "profit", "roi", "profit_pct", "has_financials",
)


def text_schema(names=RAW_COLUMNS) -> T.StructType:
    """All-text schema: types are decided by tolerant casts, never inferred."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
