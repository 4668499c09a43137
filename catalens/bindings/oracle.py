"""Independent SQL for every query key, for checking results in another engine.

The statements are built from the same table definitions as the frames in
`tables`, but with plain windows, full sorts and subqueries: they state what a
result is, not how to compute it at scale.
"""

from __future__ import annotations

from catalens.schema import ANALYSIS_COLUMNS, CLEAN_COLUMNS, RAW_COLUMNS

# --- the frames -----------------------------------------------------------

# Measures that need both money columns, each from its definition.
_BOTH = "revenue > 0 AND budget > 0"
_GAIN = "revenue - budget"
_MONEY = {
    "profit": _GAIN,
    "roi": "round(revenue / budget, 4)",
    "profit_pct": f"round(100 * ({_GAIN}) / budget, 2) + 0.0",
}
_MONEY = {name: f"if({_BOTH}, {value}, NULL)" for name, value in _MONEY.items()} | {"has_financials": _BOTH}
_DERIVED = ",\n".join(f"           {value} AS {name}" for name, value in _MONEY.items())

_CATALOG = f"""
WITH line_measures AS (
    SELECT l_orderkey,
           min(p_name) AS part_name,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS budget,
           sum(l_quantity) AS runtime,
           sum(l_quantity) / count(*) / 5 AS vote_average,
           string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS genres,
           string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS keywords
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
    GROUP BY l_orderkey
), base AS (
    SELECT o_orderkey AS id,
           part_name || ' ' || CAST(o_orderkey AS VARCHAR) AS title,
           o_orderstatus AS status,
           CAST(o_orderdate AS DATE) AS release_date,
           o_totalprice AS revenue,
           budget, runtime, vote_average,
           (o_orderkey * 7919) % 2000 AS vote_count,
           ((o_orderkey * 104729) % 100000) / 100 AS popularity,
           FALSE AS adult,
           c_mktsegment AS original_language,
           CASE WHEN o_orderkey % 17 = 0 THEN replace(genres, ', ', ',' || chr(9))
                WHEN o_orderkey % 19 = 0 THEN genres || chr(10)
                ELSE genres END AS genres,
           n_name AS production_countries,
           lang AS spoken_languages,
           keywords,
           text AS overview
    FROM orders
    LEFT JOIN line_measures ON l_orderkey = o_orderkey
    LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN documents ON doc_id = o_orderkey
), catalog AS (
    SELECT *, title AS original_title,
           CAST(year(release_date) AS INTEGER) AS release_year,
           CAST(year(release_date) // 10 * 10 AS INTEGER) AS release_decade,
           CAST(month(release_date) AS INTEGER) AS release_month,
           trim(split_part(genres, ',', 1)) AS primary_genre,
{_DERIVED}
    FROM base
)"""

_RAW = _CATALOG + """, copies AS (
    SELECT *, FALSE AS is_copy FROM base
    UNION ALL
    SELECT *, TRUE FROM base WHERE id % 20 = 0
), raw_catalog AS (
    SELECT CASE WHEN id % 79 = 0 THEN 'abc' ELSE CAST(id AS VARCHAR) END AS id,
           CASE WHEN id % 73 = 0 THEN 'call 555-123-4567'
                WHEN id % 71 = 0 THEN 'visit www.spam ' || CAST(id AS VARCHAR)
                WHEN id % 31 = 0 THEN '   '
                WHEN id % 29 = 0 THEN 'X'
                WHEN id % 23 = 0 THEN 'Unsubscribe from ' || title
                ELSE title END || CASE WHEN is_copy THEN ' dupe' ELSE '' END AS title,
           CASE WHEN id % 53 = 0 OR (id % 140 = 0 AND NOT is_copy) THEN '99'
                ELSE CAST(vote_average AS VARCHAR) END AS vote_average,
           CAST(CASE WHEN is_copy AND id % 100 = 0 THEN NULL
                     WHEN is_copy THEN vote_count - 1
                     ELSE vote_count END AS VARCHAR) AS vote_count,
           status,
           CASE WHEN id % 41 = 0 THEN 'not-a-date' WHEN id % 37 = 0 THEN ''
                WHEN id % 83 = 0 THEN '1700-01-01'
                ELSE CAST(release_date AS VARCHAR) END AS release_date,
           CASE WHEN id % 47 = 0 THEN '0' WHEN id % 43 = 0 THEN '4999999999999'
                ELSE CAST(CAST(revenue AS DECIMAL(18, 2)) AS VARCHAR) END AS revenue,
           CASE WHEN id % 59 = 0 THEN '-5' WHEN id % 89 = 0 THEN '5000' ELSE CAST(runtime AS VARCHAR) END AS runtime,
           ['True', '1', 'f', ' TRUE ', '', 't', 'no'][id % 7 + 1] AS adult,
           CAST(NULL AS VARCHAR) AS backdrop_path,
           CASE WHEN id % 47 = 0 THEN '0' WHEN id % 97 = 0 THEN '9999999999999'
                ELSE CAST(CAST(budget AS DECIMAL(18, 2)) AS VARCHAR) END AS budget,
           CAST(NULL AS VARCHAR) AS homepage,
           CAST(NULL AS VARCHAR) AS imdb_id,
           CASE WHEN id % 67 = 0 THEN '' ELSE original_language END AS original_language,
           title AS original_title,
           overview,
           CAST(popularity AS VARCHAR) AS popularity,
           CAST(NULL AS VARCHAR) AS poster_path,
           CAST(NULL AS VARCHAR) AS tagline,
           CASE WHEN id % 61 = 0 THEN '  ' ELSE genres END AS genres,
           CAST(NULL AS VARCHAR) AS production_companies,
           production_countries, spoken_languages, keywords
    FROM copies
)"""

_JUNK = r"(unsubscribe|https?://|www\.|\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b)"
_BLANKABLE = (
    "status", "original_language", "genres", "production_countries", "spoken_languages", "keywords",
)


def _cast(column: str) -> str:
    """The typed form of a raw column."""
    if column in ("id", "vote_count"):
        return f"TRY_CAST({column} AS BIGINT)"
    if column == "release_date":
        return "TRY_CAST(release_date AS DATE)"
    if column in ("revenue", "budget", "runtime", "vote_average", "popularity"):
        return f"TRY_CAST({column} AS DOUBLE)"
    if column in ("title", "original_title"):
        return f"trim({column})"
    if column == "adult":
        return "lower(trim(adult)) IN ('true', '1', 't')"
    if column in _BLANKABLE:
        return f"nullif(trim({column}), '')"
    return column


_TYPED_COLUMNS = (
    "id", "title", "original_title", "status", "release_date", "revenue", "budget", "runtime",
    "vote_average", "vote_count", "popularity", "adult", "original_language", "genres",
    "production_countries", "spoken_languages", "keywords", "overview",
)

_REQUIRED = "id IS NOT NULL AND title IS NOT NULL AND title <> '' AND release_date IS NOT NULL"
_SHORT = "(length(title) >= 2 OR vote_count >= 50)"
_NOT_JUNK = f"NOT regexp_matches(lower(title), '{_JUNK}')"
_YEARS = "year(release_date) BETWEEN 1888 AND 2028"
_RANGES = " AND ".join(
    f"coalesce({c} BETWEEN 0 AND {top}, TRUE)"
    for c, top in (("revenue", 3000000000), ("budget", 3000000000), ("runtime", 1000))
)
_RATING = "coalesce(vote_average BETWEEN 0 AND 10, TRUE)"

_TYPED = _RAW + (
    ", typed AS (SELECT " + ", ".join(f"{_cast(c)} AS {c}" for c in _TYPED_COLUMNS) + " FROM raw_catalog)"
)
_CLEAN = _TYPED + f""", passed AS (
    SELECT * FROM typed
    WHERE {" AND ".join([_REQUIRED, _SHORT, _NOT_JUNK, _YEARS, _RANGES, _RATING])}
), placed AS (
    SELECT *, row_number() OVER (
        PARTITION BY id
        ORDER BY vote_count DESC NULLS LAST, title NULLS LAST, original_title NULLS LAST, release_date NULLS LAST
    ) AS place
    FROM passed
), best AS (
    SELECT * REPLACE (
        coalesce(original_language, 'Unknown') AS original_language,
        coalesce(production_countries, 'Unknown') AS production_countries
    ) FROM placed WHERE place = 1
), clean AS (
    SELECT *,
           CAST(year(release_date) AS INTEGER) AS release_year,
           CAST(year(release_date) // 10 * 10 AS INTEGER) AS release_decade,
           CAST(month(release_date) AS INTEGER) AS release_month,
           trim(split_part(genres, ',', 1)) AS primary_genre,
{_DERIVED}
    FROM best
)"""

# --- statement shapes -----------------------------------------------------

_CREDIBLE = "has_financials AND vote_count >= 100"
_COUNT = "count(*) AS movie_count"
_MEAN = "round(avg(vote_average), 2) AS avg_rating"


def _list(columns: str, by: str, n: int | None, where: str = "TRUE", source: str = "catalog") -> str:
    """A filtered list: `by` is the whole ORDER BY text, without the id tiebreak."""
    limit = "" if n is None else f" ORDER BY {by} NULLS LAST, id LIMIT {n}"
    return f"{_CATALOG} SELECT {columns} FROM {source} WHERE {where}{limit}"


def _groups(
    key: str, measures: str, where: str = "TRUE", tail: str = "", source: str = "catalog", name: str = ""
) -> str:
    label = f"{key} AS {name}" if name else key
    return f"{_CATALOG} SELECT {label}, {measures} FROM {source} WHERE {where} GROUP BY {key} {tail}"


def _most(key: str, n: int) -> str:
    return f"ORDER BY movie_count DESC NULLS LAST, {key} NULLS LAST LIMIT {n}"


def _windowed(inner: str, where: str, keep: str, columns: str, tail: str = "") -> str:
    return (
        f"{_CATALOG} SELECT {columns} FROM (SELECT *, {inner} FROM catalog WHERE {where}) "
        f"WHERE {keep} {tail}"
    )


def _place(partition: str, by: str, name: str) -> str:
    return (
        f"CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {by} DESC NULLS LAST, id) "
        f"AS INTEGER) AS {name}"
    )


def _tokens(columns: str, keep_empty: bool) -> str:
    """Tokens: kept when empty and stripped of blanks, or of all white space and never empty."""
    kept = "" if keep_empty else "WHERE genre <> ''"
    stripped = "" if keep_empty else ", E' \\t\\n\\r'"
    return (
        f"(SELECT * FROM (SELECT {columns}, trim(unnest(string_split(genres, ',')){stripped}) AS genre "
        f"FROM catalog WHERE genres IS NOT NULL) {kept})"
    )


def _rows(names) -> str:
    return ", ".join(names)


_RANGE_BOUNDS = ((0, 60), (61, 90), (91, 120), (121, 150), (151, 180))
_RUNTIME_RANGE = (
    "CASE "
    + " ".join(f"WHEN runtime BETWEEN {a} AND {b} THEN '{a}-{b} min'" for a, b in _RANGE_BOUNDS)
    + " WHEN runtime > 180 THEN '180+ min' END"
)
_RUNTIME_BUCKET = (
    "CASE "
    + " ".join(f"WHEN runtime <= {b} THEN '{a}-{b}'" for a, b in _RANGE_BOUNDS)
    + " ELSE '180+' END"
)
# Label and range of every category.
_CATEGORY_BOUNDS = (
    ("Short (< 1hr)", "runtime < 60"),
    ("Medium (1-1.5hr)", "runtime BETWEEN 60 AND 90"),
    ("Long (1.5-2.5hr)", "runtime BETWEEN 91 AND 150"),
    ("Very Long (> 2.5hr)", "runtime > 150"),
)
_RUNTIME_CATEGORY = "coalesce(" + ", ".join(f"if({test}, '{label}', NULL)" for label, test in _CATEGORY_BOUNDS) + ")"


def _mean(column: str, where: str = "TRUE") -> str:
    return f"avg({column}) FILTER (WHERE {where})"


def _trend(digits: int = 4, where: str = "TRUE", unit: str = "", suffix: str = "") -> str:
    """Mean money, rounded, as sums of doubles depend on the order of rows."""
    return ", ".join(f"round({_mean(c, where)}{unit}, {digits}) AS avg_{c}{suffix}" for c in ("revenue", "budget"))


_TREND = f"{_COUNT}, {_trend(where=_CREDIBLE)}"
_GENRE_STATS = (
    f"{_CATALOG} SELECT genre, {_COUNT}, "
    "round(avg(vote_average) FILTER (WHERE vote_count >= 50), 2) AS avg_rating "
    f"FROM {_tokens('vote_average, vote_count', False)} GROUP BY genre"
)

# --- cleaning -------------------------------------------------------------


def _casts(columns: str) -> str:
    parsed = ", ".join(f"{_cast(c)} AS {c}" for c in columns.split())
    return f"{_RAW} SELECT id AS raw_id, {parsed} FROM raw_catalog"


def _pass(rule: str, columns: str) -> str:
    return f"{_TYPED} SELECT {columns} FROM typed WHERE {rule}"


def _from_typed(columns: str) -> str:
    return f"{_TYPED} SELECT id, {columns} FROM typed"


# Every raw row's list of what is wrong with it; a count per reason follows from the lists.
_REASONS = {
    "missing_title": f"coalesce({_cast('title')}, '') = ''",
    "bad_date": f"{_cast('release_date')} IS NULL",
    "spam_title": f"coalesce(regexp_matches(lower(title), '{_JUNK}'), FALSE)",
    "over_cap_revenue": f"coalesce({_cast('revenue')} > 3e9, FALSE)",
}
_FOUND = ", ".join(f"if({wrong}, ['{name}'], [])" for name, wrong in _REASONS.items())
_COUNTED = ", ".join(f"count(*) FILTER (list_contains(reasons, '{name}')) AS {name}" for name in _REASONS)
_DIAGNOSED = f"SELECT count(*) AS raw_rows, {_COUNTED} FROM (SELECT flatten([{_FOUND}]) AS reasons FROM raw_catalog)"
_SUMMARY = f"""{_CLEAN}, found AS ({_DIAGNOSED}),
kept AS (SELECT count(*) AS clean_rows FROM clean)
SELECT raw_rows, clean_rows, raw_rows - clean_rows AS dropped_rows,
       CASE WHEN raw_rows > 0 THEN round(100.0 * clean_rows / raw_rows, 2) ELSE 0.0 END AS pct_kept,
       missing_title, bad_date AS bad_or_missing_date, spam_title AS spam_titles, over_cap_revenue
FROM found, kept"""

CLEANING = {
    "clean_cast_long": _casts("id vote_count"),
    "clean_cast_date": _casts("release_date"),
    "clean_cast_double": _casts("revenue budget runtime vote_average popularity"),
    "clean_trim": _casts("title original_title"),
    "clean_nullif_blank": _casts(" ".join(_BLANKABLE)),
    "clean_bool": _casts("adult"),
    "clean_required": _pass(_REQUIRED, "id, title, release_date"),
    "clean_short_title": _pass(_SHORT, "id, title, vote_count"),
    "clean_spam": _pass(_NOT_JUNK, "id, title"),
    "clean_year_range": _pass(_YEARS, "id, release_date"),
    "clean_range_or_null": _pass(_RANGES, "id, revenue, budget, runtime"),
    "clean_rating_range": _pass(_RATING, "id, vote_average"),
    "clean_dedupe": f"{_CLEAN} SELECT id, title, vote_count, vote_average FROM best",
    "clean_date_parts": _from_typed(
        "CAST(year(release_date) AS INTEGER) AS release_year, "
        "CAST(month(release_date) AS INTEGER) AS release_month"
    ),
    "clean_decade": _from_typed("CAST(year(release_date) // 10 * 10 AS INTEGER) AS release_decade"),
    "clean_default": _from_typed(
        "coalesce(original_language, 'Unknown') AS original_language, "
        "coalesce(production_countries, 'Unknown') AS production_countries"
    ),
    "clean_primary_genre": _from_typed("trim(split_part(genres, ',', 1)) AS primary_genre"),
    **{f"clean_{name}": _from_typed(f"{value} AS {name}") for name, value in _MONEY.items()},
    "clean_full": f"{_CLEAN} SELECT {_rows(CLEAN_COLUMNS)} FROM clean",
    "clean_diagnostics": f"{_RAW} {_DIAGNOSED}",
    "cleaning_summary": _SUMMARY,
}

# --- files ----------------------------------------------------------------

FILES = {
    # A CSV field without characters, quoted or not, is read as NULL.
    "scan_raw_csv": f"{_RAW} SELECT "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS)
    + " FROM raw_catalog",
    "raw_schema": f"{_RAW} SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name, "
    "'string' AS column_type FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in RAW_COLUMNS)
    + "]) AS column_name)",
    "raw_row_count": f"{_RAW} SELECT count(*) AS raw_rows FROM raw_catalog",
    "scan_clean": f"{_CLEAN} SELECT {_rows(ANALYSIS_COLUMNS)} FROM clean",
    "view_movies": _groups("release_year", f"{_COUNT}, max(vote_count) AS most_votes"),
    "typed_schema": f"{_CATALOG} SELECT {_rows(CLEAN_COLUMNS)} FROM catalog",
    "sink_parquet": f"{_CLEAN} SELECT {_rows(CLEAN_COLUMNS)} FROM clean",
    "sink_table_csv": "",  # below: the contents of all summary tables
    "sink_cleaning_summary": _SUMMARY,
    "export_clean_csv": f"{_CLEAN} SELECT {_rows(CLEAN_COLUMNS)} FROM clean",
    "materialise_clean": f"{_CLEAN} SELECT {_rows(CLEAN_COLUMNS)} FROM clean",
    "reuse_clean": f"""{_CLEAN}, found AS (SELECT count(*) AS raw_rows FROM raw_catalog),
kept AS (SELECT count(*) AS clean_rows FROM clean)
SELECT 1 AS run, raw_rows, clean_rows, raw_rows - clean_rows AS dropped_rows,
       round(100.0 * clean_rows / raw_rows, 2) AS pct_kept, '' AS note, clean_rows AS table_rows FROM found, kept
UNION ALL SELECT 2, 0, 0, 0, 0.0, 'clean skipped', clean_rows FROM kept
UNION ALL SELECT 3, raw_rows, clean_rows, raw_rows - clean_rows,
       round(100.0 * clean_rows / raw_rows, 2), '', clean_rows FROM found, kept""",
    "clean_merge": f"{_CLEAN} SELECT {_rows(CLEAN_COLUMNS)} FROM clean",
    # One line of the files is malformed.
    "cleaning_observed": f"SELECT *, CAST(1 AS BIGINT) AS malformed_rows FROM ({_SUMMARY})",
    "preview": _list(_rows(CLEAN_COLUMNS), "id", 10),
}

# --- quality --------------------------------------------------------------


def _check(gate: str, name: str, passed: str, detail: str, source: str) -> str:
    return f"SELECT '{gate}' AS gate, '{name}' AS name, {passed} AS passed, {detail} AS detail FROM {source}"


def _row_floor(gate: str, name: str, floor: int, source: str) -> str:
    return _check(
        gate, name, f"count(*) >= {floor}", f"format('{{:,}} rows (floor {floor:,})', count(*))", source
    )


def _no_nulls(column: str, source: str) -> str:
    nulls = f"count(*) FILTER (WHERE {column} IS NULL)"
    return _check("clean", f"no_null_{column}", f"{nulls} = 0", f"{nulls} || ' nulls'", source)


def _rating(source: str) -> str:
    return _check(
        "clean", "rating_in_range",
        "coalesce(bool_and(vote_average BETWEEN 0 AND 10), TRUE)",
        "CASE WHEN count(vote_average) = 0 THEN 'no data' "
        "ELSE printf('min=%.1f max=%.1f', min(vote_average), max(vote_average)) END", source,
    )


def _runtime(source: str) -> str:
    return _check(
        "clean", "runtime_non_negative", "coalesce(bool_and(runtime >= 0), TRUE)",
        "CASE WHEN count(runtime) = 0 THEN 'no data' ELSE printf('min=%.0f', min(runtime)) END", source,
    )


def _unique(source: str) -> str:
    extra = f"(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {source} GROUP BY id))"
    return f"SELECT 'clean' AS gate, 'unique_id' AS name, {extra} = 0 AS passed, {extra} || ' duplicate ids' AS detail"


def _clean_gate(source: str) -> list[str]:
    return [
        _row_floor("clean", "min_clean_rows", 10000, source),
        *[_no_nulls(c, source) for c in ("id", "title", "release_date")],
        _rating(source), _runtime(source), _unique(source),
    ]


_RAW_GATE = [
    "SELECT 'raw' AS gate, 'required_columns' AS name, TRUE AS passed, 'all present' AS detail",
    _row_floor("raw", "min_raw_rows", 100000, "raw_catalog"),
]
_TWO_MISSING = (
    "SELECT 'raw' AS gate, 'required_columns' AS name, FALSE AS passed, "
    "'missing: [''title'', ''budget'']' AS detail"
)


def _all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


QUALITY = {
    "dq_required_columns": f"{_RAW} {_all([*_RAW_GATE, _TWO_MISSING])}",
    "dq_min_raw_rows": f"{_RAW} {_RAW_GATE[1]}",
    "dq_min_clean_rows": f"{_TYPED} {_row_floor('clean', 'min_clean_rows', 10000, 'typed')}",
    "dq_no_nulls": f"{_TYPED} {_all([_no_nulls(c, 'typed') for c in ('id', 'title', 'release_date')])}",
    "dq_range": f"{_TYPED} {_rating('typed')}",
    "dq_non_negative": f"{_TYPED} {_runtime('typed')}",
    "dq_unique_id": f"{_TYPED} {_unique('typed')}",
    "dq_report": f"""{_CLEAN}, report AS ({_all(_RAW_GATE + _clean_gate('clean'))}),
lines AS (SELECT gate, passed,
                 list_position(['required_columns', 'min_raw_rows', 'min_clean_rows', 'no_null_id',
                                'no_null_title', 'no_null_release_date', 'rating_in_range',
                                'runtime_non_negative', 'unique_id'], name) AS position,
                 '  ' || CASE WHEN passed THEN 'ok  ' ELSE 'XX  ' END || name || ': ' || detail AS line
          FROM report)
SELECT gate, bool_and(passed) AS ok, count(*) FILTER (WHERE NOT passed) AS failing,
       CASE WHEN bool_and(passed) THEN '[PASS] ' ELSE '[FAIL] ' END || gate || ' ('
       || count(*) FILTER (WHERE NOT passed) || ' failing)' || chr(10)
       || string_agg(line, chr(10) ORDER BY position) AS summary
FROM lines GROUP BY gate""",
    "dq_enforce": f"{_TYPED} {_all(_clean_gate('typed'))}",
}

# --- summaries and chart feeds --------------------------------------------

_BUCKETS = _groups(
    _RUNTIME_BUCKET, f"{_COUNT}, {_MEAN}", "runtime > 0 AND vote_count >= 50", name="bucket"
)

SUMMARIES = {
    "credible_financials": _list("id, revenue, budget, vote_count, has_financials", "id", None, _CREDIBLE),
    "reliable_ratings": _list("id, vote_average, vote_count", "id", None, "vote_count >= 50"),
    "explode_genres": f"{_CATALOG} SELECT id, genres, genre FROM {_tokens('id, genres', False)}",
    "summary_kpis": f"""{_CATALOG} SELECT count(*) AS total_movies,
        min(release_year) AS year_min, max(release_year) AS year_max, {_MEAN},
        count(*) FILTER (WHERE {_CREDIBLE}) AS movies_with_financials,
        round(coalesce(sum(revenue) FILTER (WHERE {_CREDIBLE}), 0) / 1e9, 1) AS total_revenue_b,
        median(runtime) AS median_runtime FROM catalog""",
    "eda_top_rated": _list(
        "title, vote_average, vote_count, release_year", "vote_average DESC", 10, "vote_count >= 1000"
    ),
    "eda_top_revenue": _list(
        "title, revenue, budget, profit, release_year", "revenue DESC", 10, _CREDIBLE
    ),
    "eda_top_roi": _list(
        "title, budget, revenue, roi, release_year", "roi DESC", 10, f"{_CREDIBLE} AND budget >= 100000"
    ),
    "eda_genre_stats": _GENRE_STATS,
    "eda_yearly_trend": _groups("release_year", _TREND),
    "eda_runtime_buckets": _BUCKETS,
    "eda_language_stats": _groups(
        "original_language", f"{_COUNT}, {_MEAN}", "original_language IS NOT NULL",
        _most("original_language", 3),
    ),
    "eda_monthly_releases": _groups("release_month", _COUNT),
    "run_eda": "",  # below
    "feed_movies_per_year": _groups("release_year", _COUNT),
    "feed_money_millions": _groups("release_year", _trend(9, _CREDIBLE, " / 1e6", "_m")),
    "feed_top_genres": f"{_GENRE_STATS} {_most('genre', 4)}",
    "feed_runtime_rating": _groups(
        _RUNTIME_BUCKET, _MEAN, "runtime > 0 AND vote_count >= 50", name="bucket"
    ),
    "feed_top_revenue": _list("title, revenue / 1e6 AS revenue_m", "revenue DESC", 10, _CREDIBLE),
    "feed_monthly": _groups("release_month", _COUNT),
}

# What of each summary table goes into the common layout: key, label, n, x, y.
_COMMON = {
    "top_rated": ("eda_top_rated", "title", "vote_count", "vote_average", "NULL"),
    "top_revenue": ("eda_top_revenue", "title", "NULL", "revenue", "budget"),
    "top_roi": ("eda_top_roi", "title", "NULL", "revenue", "budget"),
    "genre_stats": ("eda_genre_stats", "genre", "movie_count", "avg_rating", "NULL"),
    "yearly_trend": ("eda_yearly_trend", "release_year", "movie_count", "avg_revenue", "avg_budget"),
    "runtime_buckets": ("eda_runtime_buckets", "bucket", "movie_count", "avg_rating", "NULL"),
    "language_stats": ("all_languages", "original_language", "movie_count", "avg_rating", "NULL"),
    "monthly_releases": ("eda_monthly_releases", "release_month", "movie_count", "NULL", "NULL"),
}
_ALL_LANGUAGES = _groups(
    "original_language", f"{_COUNT}, {_MEAN}", "original_language IS NOT NULL", _most("original_language", 15)
)
_EDA = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST({label} AS VARCHAR) AS label, CAST({n} AS BIGINT) AS n, "
    f"round(CAST({x} AS DOUBLE), 4) AS x, round(CAST({y} AS DOUBLE), 4) AS y "
    f"FROM ({SUMMARIES.get(key, _ALL_LANGUAGES)})"
    for name, (key, label, n, x, y) in _COMMON.items()
)
SUMMARIES["run_eda"] = FILES["sink_table_csv"] = _EDA

# --- report catalogue -----------------------------------------------------

_ROUND_MONEY = "round(avg(revenue)) AS avg_revenue, round(avg(budget)) AS avg_budget"
_LANGUAGE_RATING = _groups(
    "original_language", f"{_COUNT}, {_MEAN}", "vote_count >= 10", "HAVING count(*) >= 3000"
)
_CATEGORIES = _groups(_RUNTIME_CATEGORY, f"{_COUNT}, {_MEAN}", "runtime > 0", name="runtime_category")
_ABOVE = (
    "vote_count >= 500 AND vote_average > "
    "(SELECT avg(vote_average) FROM catalog WHERE vote_count >= 500)"
)
_LANGUAGE_TOP = _windowed(
    _place("original_language", "vote_average", "place"), "vote_count >= 100", "place = 1",
    "title, original_language, vote_average, vote_count", "ORDER BY vote_average DESC NULLS LAST, id LIMIT 3",
)


def _percentile(where: str) -> str:
    return _windowed(
        "round(percent_rank() OVER (ORDER BY revenue) * 100, 1) AS revenue_percentile", where, "TRUE",
        "title, revenue, revenue_percentile", "ORDER BY revenue DESC NULLS LAST, id LIMIT 30",
    )


def _search(column: str, phrase: str, columns: str, votes: int = 0) -> str:
    floor = f" AND vote_count >= {votes}" if votes else ""
    return _list(columns, "vote_average DESC", 20, f"contains(lower({column}), lower('{phrase}')){floor}")


CATALOGUE = {
    "q01_top_rated": _list(
        "title, vote_average, vote_count, release_year", "vote_average DESC", 20, "vote_count >= 1000"
    ),
    "q01_top10_per_decade": _windowed(
        _place("release_decade", "vote_average", "place"), "vote_count >= 1000", "place <= 10",
        "title, vote_average, vote_count, release_decade",
    ),
    "q02_top_revenue": _list(
        "title, revenue, budget, profit, release_year", "revenue DESC", 20, _CREDIBLE
    ),
    "q02_top_roi": _list(
        "title, budget, revenue, roi, release_year", "roi DESC", 20, f"{_CREDIBLE} AND budget >= 100000"
    ),
    "q02_yearly_money": _groups("release_year", f"{_COUNT}, {_ROUND_MONEY}", _CREDIBLE),
    "q02_flops": _list(
        "title, budget, revenue, profit, release_year", "profit ASC", 10, f"{_CREDIBLE} AND profit < 0"
    ),
    "q03_primary_genre_count": _groups("primary_genre", _COUNT, "primary_genre <> ''"),
    "q03_genre_stats": f"{_CATALOG} SELECT genre, {_COUNT}, "
    "round(avg(vote_average) FILTER (WHERE vote_count >= 50), 2) AS avg_rating "
    f"FROM {_tokens('vote_average, vote_count', True)} GROUP BY genre HAVING count(*) >= 7000",
    "q03_genre_revenue": f"{_CATALOG} SELECT genre, round(avg(revenue)) AS avg_revenue "
    f"FROM {_tokens('revenue, vote_count, has_financials', True)} WHERE {_CREDIBLE} "
    "GROUP BY genre HAVING count(*) >= 6500",
    "q04_top_languages": _groups("original_language", _COUNT, tail=_most("original_language", 3)),
    "q04_language_rating": _LANGUAGE_RATING,
    "q04_top_countries": _groups(
        "production_countries", _COUNT, "production_countries <> 'Unknown'", _most("production_countries", 15)
    ),
    "q05_runtime_category": _CATEGORIES,
    "q05_runtime_range": _groups(
        _RUNTIME_RANGE, f"{_COUNT}, {_MEAN}", "runtime > 0 AND vote_count >= 50", name="runtime_range"
    ),
    "q05_longest": _list("title, runtime, vote_average, release_year", "runtime DESC", 10, "runtime > 0"),
    "q06_per_year": _groups("release_year", _COUNT),
    "q06_most_popular_per_year": _windowed(
        _place("release_year", "popularity", "place"), "popularity IS NOT NULL", "place = 1",
        "title, popularity, release_year", "ORDER BY release_year DESC LIMIT 5",
    ),
    "q06_per_month": _groups("release_month", _COUNT),
    "q07_title_search": _search("title", "widget", "title, vote_average, release_year, overview", 100),
    "q07_overview_search": _search("overview", "the", "title, vote_average, release_year"),
    "q07_longest_titles": _list(
        "title, CAST(length(title) AS INTEGER) AS title_length, release_year", "length(title) DESC", 15
    ),
    "q07_keyword_search": _search(
        "keywords", "Brand#12", "title, keywords, vote_average, release_year", 50
    ),
    "q08_above_average": _list("title, vote_average, release_year", "vote_average DESC", 20, _ABOVE),
    "q08_language_top": _LANGUAGE_TOP,
    "q08_revenue_percentile": _percentile(_CREDIBLE),
    "q09_rank_dense_rank": _windowed(
        "CAST(rank() OVER (ORDER BY vote_average DESC NULLS LAST) AS INTEGER) AS rank_with_gaps, "
        "CAST(dense_rank() OVER (ORDER BY vote_average DESC NULLS LAST) AS INTEGER) AS dense_rank_no_gaps",
        "vote_count >= 500", "TRUE", "title, vote_average, vote_count, rank_with_gaps, dense_rank_no_gaps",
        "ORDER BY vote_average DESC NULLS LAST, id LIMIT 25",
    ),
    "q09_genre_rank": _windowed(
        "CAST(rank() OVER (PARTITION BY primary_genre ORDER BY revenue DESC NULLS LAST) AS INTEGER) AS genre_rank",
        _CREDIBLE, "genre_rank <= 5", "title, primary_genre, revenue, genre_rank",
    ),
    "q09_top_per_year": _windowed(
        _place("release_year", "vote_average", "yr_rank"), "vote_count >= 500", "yr_rank = 1",
        "title, release_year, vote_average, yr_rank", "ORDER BY release_year DESC LIMIT 5",
    ),
    "q09_decade_dense_top3": _windowed(
        "CAST(dense_rank() OVER (PARTITION BY release_decade ORDER BY vote_average DESC NULLS LAST) AS INTEGER) AS dr",
        "vote_count >= 1000", "dr <= 3", "title, release_decade, vote_average, dr",
    ),
    "q09_lead_revenue": _windowed(
        "lead(revenue) OVER (PARTITION BY primary_genre ORDER BY revenue DESC NULLS LAST, id) AS next_revenue",
        _CREDIBLE, "TRUE", "title, primary_genre, revenue, next_revenue",
        "ORDER BY primary_genre NULLS LAST, revenue DESC NULLS LAST, id LIMIT 40",
    ),
    "q09_lag_growth": _windowed(
        "revenue - lag(revenue) OVER (PARTITION BY primary_genre ORDER BY release_date NULLS LAST, id) "
        "AS growth_vs_prev",
        _CREDIBLE, "TRUE", "title, primary_genre, release_date, revenue, growth_vs_prev",
        "ORDER BY primary_genre NULLS LAST, release_date NULLS LAST, id LIMIT 40",
    ),
    "q09_language_windows": _windowed(
        "CAST(dense_rank() OVER (PARTITION BY original_language ORDER BY popularity DESC NULLS LAST) AS INTEGER) "
        "AS lang_rank, round(avg(popularity) OVER (PARTITION BY original_language), 2) AS lang_avg_popularity",
        "vote_count >= 500", "TRUE", "title, original_language, popularity, lang_rank, lang_avg_popularity",
        "ORDER BY original_language NULLS LAST, popularity DESC NULLS LAST, id LIMIT 50",
    ),
}

# --- the earlier report set -----------------------------------------------

_LISTED = ("Economy", "Standard", "Medium", "Promo", "Large", "Small", "mall", "Action")


def _listed(measures: str, where: str = "TRUE", tail: str = "") -> str:
    parts = [
        f"SELECT '{tag}' AS genre, {measures} FROM catalog WHERE contains(lower(genres), lower('{tag}')) AND {where}"
        for tag in _LISTED
    ]
    return f"{_CATALOG} SELECT * FROM ({_all(parts)}) {tail}"


EARLY = {
    "l_top_rated_dates": _list(
        "title, vote_average, vote_count, release_date", "vote_average DESC", 20, "vote_count >= 1000"
    ),
    "l_top10_per_decade": _windowed(
        "release_decade AS decade, " + _place("release_decade", "vote_average", "rank"),
        "vote_count >= 1000 AND release_date IS NOT NULL", "rank <= 10",
        "title, vote_average, vote_count, release_date, decade, rank",
    ),
    "l_top_revenue_any": _list("title, revenue, budget, release_date", "revenue DESC", 20, "revenue > 0"),
    "l_roi_inline": _list(
        "title, budget, revenue, round(revenue / budget, 2) AS roi, release_date",
        "round(revenue / budget, 2) DESC", 20, _BOTH,
    ),
    "l_yearly_money_any": _groups("release_year", f"{_COUNT}, {_ROUND_MONEY}", _BOTH),
    "l_flops_loss": _list(
        "title, budget, revenue, budget - revenue AS loss, release_date", "budget - revenue DESC", 10,
        f"{_BOTH} AND revenue < budget",
    ),
    "l_tracked_genre_count": _listed('count(*) AS "count"'),
    "l_tracked_genre_rating": _listed(
        f"{_MEAN}, {_COUNT}", "vote_count >= 50", "ORDER BY avg_rating DESC NULLS LAST, genre LIMIT 5"
    ),
    "l_tracked_genre_revenue": _listed("round(avg(revenue), 0) AS avg_revenue", "revenue > 0"),
    "l_languages_nonnull": _groups(
        "original_language", _COUNT, "original_language IS NOT NULL", _most("original_language", 3)
    ),
    "l_language_rating": _LANGUAGE_RATING,
    "l_countries_nonempty": _groups(
        "production_countries", _COUNT, "production_countries <> ''", _most("production_countries", 15)
    ),
    "l_runtime_category": _CATEGORIES,
    "l_runtime_range_revenue": _groups(
        _RUNTIME_RANGE, f"{_COUNT}, {_MEAN}, round(avg(revenue)) AS avg_revenue",
        "runtime > 0 AND vote_count >= 50", name="runtime_range",
    ),
    "l_longest_capped": _list(
        "title, runtime, vote_average, release_date", "runtime DESC", 10, "runtime > 0 AND runtime < 1000"
    ),
    "l_shortest_features": _list(
        "title, runtime, vote_average, release_date", "runtime ASC", 10, "runtime >= 40"
    ),
    "l_per_year": _groups("release_year", _COUNT, "release_date IS NOT NULL"),
    "l_most_popular_per_year": _windowed(
        _place("release_year", "popularity", "rank"), "release_date IS NOT NULL AND popularity IS NOT NULL",
        "rank = 1", "title, popularity, release_year, rank", "ORDER BY release_year DESC LIMIT 5",
    ),
    "l_month_name": _groups("release_month, monthname(release_date)", _COUNT).replace(
        "monthname(release_date), count", "monthname(release_date) AS month_name, count"
    ),
    "l_title_search": _search("title", "widget", "title, vote_average, release_date, overview", 100),
    "l_overview_search": _search("overview", "the", "title, vote_average, release_date"),
    "l_keyword_search": _search("keywords", "Brand#12", "title, keywords, vote_average, release_date", 50),
    "l_longest_titles": _list(
        "title, CAST(length(title) AS INTEGER) AS title_length, release_date", "length(title) DESC", 15,
        "title IS NOT NULL",
    ),
    "l_shortest_titles": _list(
        "title, CAST(length(title) AS INTEGER) AS title_length, vote_average, release_date",
        "length(title) ASC", 15, "length(title) >= 1",
    ),
    "l_above_average": _list("title, vote_average, release_date", "vote_average DESC", 20, _ABOVE),
    "l_language_top": _LANGUAGE_TOP,
    "l_revenue_percentile": _percentile("revenue > 0"),
    "l_profit_top10": _list(
        "title, revenue, budget, revenue - budget AS profit", "revenue DESC", 10, _BOTH
    ),
    "l_top_popular": _list("title, popularity, vote_average, release_date", "popularity DESC", 20),
    "l_top_profit_pct": _list(
        "title, budget, revenue, profit_pct", "profit_pct DESC", 10, f"{_BOTH} AND budget >= 100000"
    ),
    "l_status_distribution": _groups("status", _COUNT),
}

# --- slices ---------------------------------------------------------------

_SELECTED = (
    "vote_count >= 100 AND release_year BETWEEN 1996 AND 2000 "
    "AND (contains(genres, 'ECONOMY') OR contains(genres, 'PROMO')) "
    "AND original_language IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"
)
_SELECTED_CREDIBLE = f"{_SELECTED} AND {_CREDIBLE}"

SLICES = {
    "slice_bounds": f"{_CATALOG} SELECT min(release_year) AS year_min, max(release_year) AS year_max FROM catalog",
    "slice_genre_domain": f"{_CATALOG} SELECT DISTINCT genre FROM {_tokens('id', False)}",
    "slice_language_domain": f"{_CATALOG} SELECT original_language FROM catalog "
    "WHERE original_language IS NOT NULL GROUP BY original_language "
    "ORDER BY count(*) DESC, original_language LIMIT 3",
    "slice_filter": _list(
        "release_year, vote_count, genres, original_language, id, title", "id", None, _SELECTED
    ),
    "slice_kpis": f"""{_CATALOG} SELECT {_COUNT}, {_MEAN},
        round(sum(revenue) FILTER (WHERE {_CREDIBLE}) / 1e9, 1) AS total_revenue_b,
        round(median(runtime), 0) AS median_runtime FROM catalog WHERE {_SELECTED}""",
    "slice_per_year": _groups("release_year", 'count(*) AS "count"', _SELECTED),
    "slice_rating_histogram": f"""{_CATALOG}
        SELECT bin, (bin - 1) * 0.25::DOUBLE AS from_rating, count(*) AS "count"
        FROM (SELECT least(CAST(floor(vote_average / 0.25::DOUBLE) AS BIGINT) + 1, 40) AS bin
              FROM catalog WHERE vote_average IS NOT NULL AND {_SELECTED})
        GROUP BY bin""",
    "slice_top_genres": f"""{_CATALOG} SELECT genre, count(*) AS "count"
        FROM {_tokens('vote_count, release_year, genres, original_language', False)}
        WHERE {_SELECTED} GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 4""",
    "slice_money_trend": _groups(
        "release_year",
        _trend(),
        _SELECTED_CREDIBLE,
    ),
    "slice_top_rated": _list(
        "title, vote_average, vote_count, release_year, primary_genre", "vote_average DESC", 15, _SELECTED
    ),
    "slice_top_grossing": _list(
        "title, revenue, budget, profit, release_year", "revenue DESC", 15, _SELECTED_CREDIBLE
    ),
}


# The cube's panels are the slice panels.
CUBE = {f"cube_{key.removeprefix('slice_')}": sql for key, sql in SLICES.items() if key != "slice_filter"}


# Other ways to the same rows.
INDEXES = {
    "dq_unique_bitmap": QUALITY["dq_unique_id"],
    "run_eda_shared": SUMMARIES["run_eda"],
    "search_title": CATALOGUE["q07_title_search"],
    "search_overview": CATALOGUE["q07_overview_search"],
    "search_keywords": CATALOGUE["q07_keyword_search"],
    "sink_clustered": FILES["sink_parquet"],
    "heavy_languages": CATALOGUE["q04_top_languages"],
    "heavy_countries": CATALOGUE["q04_top_countries"],
    "exact_median_revenue": f"{_CATALOG} SELECT median(revenue) AS median FROM catalog",
}


def oracle_sql() -> dict[str, str]:
    return {**FILES, **CLEANING, **QUALITY, **SUMMARIES, **CATALOGUE, **EARLY, **SLICES, **CUBE, **INDEXES}
