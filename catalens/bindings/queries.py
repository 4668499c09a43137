"""Query key -> callable(spark, sf_dir) over the order-grain frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.bindings.tables import catalog, raw_catalog
from catalens.functions import rules
from catalens.operators import cleaning, heavy, median, quality, trigrams
from catalens.operators.tags import explode_tags
from catalens.params import CleanRules, QualityRules, ReportRules, Slice
from catalens.plans import catalogue, cube, early, slices, summaries
from catalens.plans.batch import clean_or_reuse
from catalens.schema import ANALYSIS_COLUMNS, CLEAN_COLUMNS, CLEAN_SCHEMA, RAW_COLUMNS, text_schema
from catalens.sources import clustered, files, versions

Query = Callable[[SparkSession, str], DataFrame]

LIMITS = CleanRules()
GATES = QualityRules()

# Lists and floors small enough that the test tables go over or under them.
FEW = ReportRules(top_n=3, min_language_rows=3)
LANGUAGE_ROWS = 3_000

# What the searches look for in the test tables.
TITLE_PHRASE, KEYWORD_PHRASE, OVERVIEW_PHRASE = "widget", "Brand#12", "the"
# Whole tags in another case, a part of a tag ("mall"), and a tag without a row.
LISTED_TAGS = ("Economy", "Standard", "Medium", "Promo", "Large", "Small", "mall", "Action")
SELECTION = Slice(
    first_year=1996,
    last_year=2000,
    genres=("ECONOMY", "PROMO"),
    languages=("AUTOMOBILE", "BUILDING", "MACHINERY"),
)


@dataclass(frozen=True)
class CatalogReport:
    """A report bound to the columns of the catalog frame that it reads."""

    report: Callable[..., DataFrame]
    columns: tuple[str, ...]
    options: dict

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.over(catalog(spark, sf_dir, *self.columns))

    def over(self, rows: DataFrame) -> DataFrame:
        """The report over any frame in the clean layout, such as a stored table."""
        return self.report(rows, **self.options)


def _on_catalog(report: Callable[..., DataFrame], columns: str, **options) -> CatalogReport:
    return CatalogReport(report, tuple(columns.split()), options)


def _on_raw(step: Callable[[DataFrame], DataFrame], columns: str) -> Query:
    return lambda spark, sf_dir: step(raw_catalog(spark, sf_dir, *columns.split()))


def _parsed(columns: str) -> Query:
    """Typed columns next to the id as written."""

    def step(raw: DataFrame) -> DataFrame:
        return raw.select(F.col("id").alias("raw_id"), *map(cleaning.parsed, columns.split()))

    return _on_raw(step, " ".join(dict.fromkeys(["id", *columns.split()])))


def _passing(rule: Callable[[], object], columns: str) -> Query:
    """Typed rows that pass one rule of the gate."""
    return _on_raw(lambda raw: cleaning.typed(raw, *columns.split()).filter(rule()), columns)


def _derived(step: Callable[[DataFrame], DataFrame], columns: str, output: str) -> Query:
    def run(raw: DataFrame) -> DataFrame:
        rows = cleaning.typed(raw, *columns.split())
        return rows.transform(step).select(*output.split())

    return _on_raw(run, columns)


def _with(**columns: Callable[[], object]):
    return lambda rows: rows.withColumns({name: build() for name, build in columns.items()})


def _money(measure) -> Callable[[], object]:
    return lambda: measure(F.col("revenue"), F.col("budget"))


CLEANING: dict[str, Query] = {
    "clean_cast_long": _parsed("id vote_count"),
    "clean_cast_date": _parsed("release_date"),
    "clean_cast_double": _parsed("revenue budget runtime vote_average popularity"),
    "clean_trim": _parsed("title original_title"),
    "clean_nullif_blank": _parsed(
        "status original_language genres production_countries spoken_languages keywords"
    ),
    "clean_bool": _parsed("adult"),
    "clean_required": _passing(cleaning.has_required, "id title release_date"),
    "clean_short_title": _passing(lambda: cleaning.title_long_enough(LIMITS), "id title vote_count"),
    "clean_spam": _passing(lambda: cleaning.title_not_junk(LIMITS), "id title"),
    "clean_year_range": _passing(lambda: cleaning.year_in_range(LIMITS), "id release_date"),
    "clean_range_or_null": _passing(
        lambda: cleaning.measures_in_range(LIMITS), "id revenue budget runtime"
    ),
    "clean_rating_range": _passing(lambda: cleaning.rating_in_range(LIMITS), "id vote_average"),
    "clean_dedupe": lambda spark, sf_dir: (
        raw_catalog(spark, sf_dir)
        .transform(cleaning.typed)
        .transform(cleaning.admissible, LIMITS)
        .transform(cleaning.best_copy)
        .select("id", "title", "vote_count", "vote_average")
    ),
    "clean_date_parts": _derived(
        cleaning.with_date_parts, "id release_date", "id release_year release_month"
    ),
    "clean_decade": _derived(cleaning.with_date_parts, "id release_date", "id release_decade"),
    "clean_default": _derived(
        cleaning.with_labels,
        "id original_language production_countries genres",
        "id original_language production_countries",
    ),
    "clean_primary_genre": _derived(
        _with(primary_genre=lambda: rules.first_token(F.col("genres"))), "id genres", "id primary_genre"
    ),
    "clean_profit": _derived(_with(profit=_money(rules.profit)), "id revenue budget", "id profit"),
    "clean_roi": _derived(_with(roi=_money(rules.return_on_budget)), "id revenue budget", "id roi"),
    "clean_profit_pct": _derived(
        _with(profit_pct=_money(rules.profit_percent)), "id revenue budget", "id profit_pct"
    ),
    "clean_has_financials": _derived(
        _with(has_financials=_money(rules.both_known)), "id revenue budget", "id has_financials"
    ),
    "clean_full": lambda spark, sf_dir: cleaning.clean(raw_catalog(spark, sf_dir), LIMITS),
    "clean_diagnostics": _on_raw(
        lambda raw: cleaning.diagnostics(raw, LIMITS), "title release_date revenue"
    ),
    "cleaning_summary": lambda spark, sf_dir: cleaning.cleaning_summary(
        cleaning.diagnostics(raw_catalog(spark, sf_dir, "title", "release_date", "revenue"), LIMITS),
        cleaning.clean(raw_catalog(spark, sf_dir), LIMITS),
    ),
}


# --- files ----------------------------------------------------------------


def _raw_file(spark: SparkSession, sf_dir: str) -> str:
    """The raw table as CSV, and beside it a file with a line of too few fields."""
    path = files.shared_folder(spark)
    files.write_raw_csv(raw_catalog(spark, sf_dir), path)
    broken = spark.createDataFrame([(",".join(RAW_COLUMNS) + "\n1,two,3",)], "line string")
    broken.coalesce(1).write.mode("append").text(path)
    return path


def _scan_raw_csv(spark, sf_dir):
    return files.read_raw_csv(spark, _raw_file(spark, sf_dir))


def _raw_schema(spark, sf_dir):
    schema = files.raw_schema(spark, _raw_file(spark, sf_dir))
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema, start=1)]
    return spark.createDataFrame(rows, "position int, column_name string, column_type string")


def _raw_row_count(spark, sf_dir):
    return _scan_raw_csv(spark, sf_dir).agg(F.count("*").alias("raw_rows"))


def _clean_file(spark: SparkSession, sf_dir: str) -> str:
    path = files.shared_folder(spark)
    files.write_clean(cleaning.clean(raw_catalog(spark, sf_dir), LIMITS), path)
    return path


def _scan_clean(spark, sf_dir):
    return files.read_clean(spark, _clean_file(spark, sf_dir))


def _sink_parquet(spark, sf_dir):
    return files.read_clean(spark, _clean_file(spark, sf_dir), columns=None)


def _view_movies(spark, sf_dir):
    files.register_view(catalog(spark, sf_dir, "release_year", "vote_count"))
    return spark.sql(
        "SELECT release_year, count(*) AS movie_count, max(vote_count) AS most_votes "
        "FROM movies GROUP BY release_year"
    )


def _materialise_clean(spark, sf_dir):
    cleaned = cleaning.clean(raw_catalog(spark, sf_dir), LIMITS)
    return files.materialise(cleaned, files.shared_folder(spark))


def _reuse_clean(spark, sf_dir):
    """Three runs that may reuse a clean table: none is there, so it is built; it is taken;
    the raw files are written anew, so it is built again."""
    path, raw_path = files.shared_folder(spark), files.shared_folder(spark)
    raw = files.materialise(raw_catalog(spark, sf_dir), raw_path)
    counts = ["raw_rows", "clean_rows", "dropped_rows", "pct_kept"]
    outcomes = []
    for number in (1, 2, 3):
        if number == 3:
            raw = files.write_anew(spark, raw_path)
        digest = versions.input_digest(spark, raw_path, LIMITS)
        cleaned, summary, _ = clean_or_reuse(spark, lambda: raw, path, digest, LIMITS, reuse=True)
        note = F.col("note") if "note" in summary.columns else F.lit("")
        outcomes.append(summary.select(
            F.lit(number).alias("run"), *counts, note.alias("note"), F.lit(cleaned.count()).cast("bigint").alias("table_rows")
        ))
    return reduce(DataFrame.unionByName, outcomes)


def _clean_merge(spark, sf_dir):
    """The raw rows in two deliveries, copies of an id in either, merged one after the other."""
    raw = files.materialise(raw_catalog(spark, sf_dir), files.shared_folder(spark))  # both deliveries come from it
    second = F.pmod(F.xxhash64("title", "vote_count"), F.lit(2)) == 1
    table = versions.BucketTable(spark, files.shared_folder(spark), buckets=16)
    table.merge(raw.where(~second), LIMITS)
    table.merge(raw.where(second), LIMITS)
    return table.read()


def _cleaning_observed(spark, sf_dir):
    """The summary from counts that were observed while the raw files were cleaned."""
    raw = files.read_raw_csv(spark, _raw_file(spark, sf_dir), text_schema(), keep_malformed=True)
    observed, path = cleaning.Observed(raw, LIMITS), files.shared_folder(spark)
    counts = observed.counts() if observed.write(path) else observed.recount(path)
    return cleaning.summary_of(spark, counts)


def _stored_catalog(spark, sf_dir):
    """The analysed columns, written once for the many reports over them."""
    return files.materialise(catalog(spark, sf_dir, *ANALYSIS_COLUMNS), files.shared_folder(spark))


# What of each summary table goes into the common layout: label, n, x, y.
_COMMON = {
    "top_rated": ("title", "vote_count", "vote_average", None),
    "top_revenue": ("title", None, "revenue", "budget"),
    "top_roi": ("title", None, "revenue", "budget"),
    "genre_stats": ("genre", "movie_count", "avg_rating", None),
    "yearly_trend": ("release_year", "movie_count", "avg_revenue", "avg_budget"),
    "runtime_buckets": ("bucket", "movie_count", "avg_rating", None),
    "language_stats": ("original_language", "movie_count", "avg_rating", None),
    "monthly_releases": ("release_month", "movie_count", None, None),
}


def _common(tables: dict[str, DataFrame]) -> DataFrame:
    """The contents of all summary tables in one layout; means to four places."""
    def number(column, kind):
        value = (F.lit(None) if column is None else F.col(column)).cast(kind)
        return F.round(value, 4) if kind == "double" else value

    return reduce(DataFrame.unionByName, [
        tables[name].select(
            F.lit(name).alias("table_name"), F.col(label).cast("string").alias("label"),
            number(n, "bigint").alias("n"), number(x, "double").alias("x"), number(y, "double").alias("y"),
        )
        for name, (label, n, x, y) in _COMMON.items()
    ])


def _sink_table_csv(spark, sf_dir):
    """Every summary table goes out as CSV and is read back."""
    folder = files.shared_folder(spark)
    tables = summaries.run_eda(_stored_catalog(spark, sf_dir))
    paths = {name: files.write_report_csv(rows, folder, name) for name, rows in tables.items()}
    return _common({
        name: spark.read.schema(rows.schema).csv(paths[name], header=True, quote='"', escape='"', multiLine=True)
        for name, rows in tables.items()
    })


def _sink_cleaning_summary(spark, sf_dir):
    summary = CLEANING["cleaning_summary"](spark, sf_dir)
    path = files.write_report_csv(summary, files.shared_folder(spark), "cleaning_summary")
    return spark.read.schema(summary.schema).csv(path, header=True)


def _export_clean_csv(spark, sf_dir):
    path = files.shared_folder(spark)
    files.export_clean_csv(cleaning.clean(raw_catalog(spark, sf_dir), LIMITS), path)
    reader = spark.read.schema(CLEAN_SCHEMA).options(header=True, quote='"', escape='"', multiLine=True)
    return reader.csv(path)


FILES: dict[str, Query] = {
    "scan_raw_csv": _scan_raw_csv,
    "raw_schema": _raw_schema,
    "raw_row_count": _raw_row_count,
    "scan_clean": _scan_clean,
    "view_movies": _view_movies,
    "typed_schema": lambda spark, sf_dir: files.conform(catalog(spark, sf_dir)),
    "sink_parquet": _sink_parquet,
    "sink_table_csv": _sink_table_csv,
    "sink_cleaning_summary": _sink_cleaning_summary,
    "export_clean_csv": _export_clean_csv,
    "materialise_clean": _materialise_clean,
    "reuse_clean": _reuse_clean,
    "clean_merge": _clean_merge,
    "cleaning_observed": _cleaning_observed,
    "preview": _on_catalog(files.preview, " ".join(CLEAN_COLUMNS)),
}


# --- quality --------------------------------------------------------------

_TYPED_KEYS = "id title release_date vote_average runtime"


def _check_typed(columns: str, *names: str) -> Query:
    """Checks over the typed rows before the gate, where some of them fail."""
    return _on_raw(
        lambda raw: quality.check_clean(cleaning.typed(raw, *columns.split()), GATES, only=names), columns
    )


def _gates(spark, sf_dir):
    """Both gates over one report: the raw rows and what cleaning made of them."""
    raw = raw_catalog(spark, sf_dir)
    found = cleaning.diagnostics(raw, LIMITS)
    before = quality.check_raw_counted(raw.columns, found, GATES)
    return before.unionByName(quality.check_clean(cleaning.clean(raw, LIMITS), GATES))


def _required_columns(spark, sf_dir):
    """The raw gate over the whole header, and over one that lacks two names."""
    raw = raw_catalog(spark, sf_dir)
    fewer = quality.check_raw(raw.drop("title", "budget"), GATES, only=["required_columns"])
    return quality.check_raw(raw, GATES).unionByName(fewer)


QUALITY: dict[str, Query] = {
    "dq_required_columns": _required_columns,
    "dq_min_raw_rows": _on_raw(
        lambda raw: quality.check_raw(raw, GATES, only=["min_raw_rows"]), "id"
    ),
    "dq_min_clean_rows": _check_typed("id", "min_clean_rows"),
    "dq_no_nulls": _check_typed("id title release_date", "no_null_id", "no_null_title", "no_null_release_date"),
    "dq_range": _check_typed("id vote_average", "rating_in_range"),
    "dq_non_negative": _check_typed("id runtime", "runtime_non_negative"),
    "dq_unique_id": _check_typed("id", "unique_id"),
    "dq_report": lambda spark, sf_dir: quality.verdict(_gates(spark, sf_dir)),
    "dq_enforce": _on_raw(
        lambda raw: quality.enforce(
            quality.check_clean(cleaning.typed(raw, *_TYPED_KEYS.split()), GATES), GATES
        ),
        _TYPED_KEYS,
    ),
}


# --- summaries and chart feeds --------------------------------------------

_CREDIBLE = "vote_count has_financials"


def _run_eda(spark, sf_dir):
    """The contents of every summary table, over one stored frame."""
    return _common(summaries.run_eda(_stored_catalog(spark, sf_dir)))


def _rounded(report: Callable[..., DataFrame], **digits: int) -> Callable[..., DataFrame]:
    """Means of doubles depend on the order of rows in their last digits: compare fewer."""
    return lambda rows, **options: report(rows, **options).withColumns(
        {name: F.round(name, n) for name, n in digits.items()}
    )


SUMMARIES: dict[str, Query] = {
    "credible_financials": _on_catalog(
        summaries.credible_financials, f"id revenue budget {_CREDIBLE}"
    ),
    "reliable_ratings": _on_catalog(summaries.reliable_ratings, "id vote_average vote_count"),
    "explode_genres": _on_catalog(explode_tags, "id genres"),
    "summary_kpis": _on_catalog(
        summaries.summary_kpis, f"release_year vote_average revenue runtime {_CREDIBLE}"
    ),
    "eda_top_rated": _on_catalog(summaries.top_rated, "id title vote_average vote_count release_year"),
    "eda_top_revenue": _on_catalog(
        summaries.top_revenue, f"id title revenue budget profit release_year {_CREDIBLE}"
    ),
    "eda_top_roi": _on_catalog(
        summaries.top_roi, f"id title budget revenue roi release_year {_CREDIBLE}"
    ),
    "eda_genre_stats": _on_catalog(summaries.genre_stats, "genres vote_count vote_average"),
    "eda_yearly_trend": _on_catalog(_rounded(summaries.yearly_trend, avg_revenue=4, avg_budget=4), f"release_year revenue budget {_CREDIBLE}"),
    "eda_runtime_buckets": _on_catalog(summaries.runtime_buckets, "runtime vote_average vote_count"),
    "eda_language_stats": _on_catalog(
        summaries.language_stats, "original_language vote_average", limits=FEW
    ),
    "eda_monthly_releases": _on_catalog(summaries.monthly_releases, "release_month"),
    "run_eda": _run_eda,
    "feed_movies_per_year": _on_catalog(summaries.feed_movies_per_year, "release_year"),
    "feed_money_millions": _on_catalog(
        _rounded(summaries.feed_money_millions, avg_revenue_m=9, avg_budget_m=9), f"release_year revenue budget {_CREDIBLE}"
    ),
    "feed_top_genres": _on_catalog(summaries.feed_top_genres, "genres vote_count vote_average", n=4),
    "feed_runtime_rating": _on_catalog(summaries.feed_runtime_rating, "runtime vote_average vote_count"),
    "feed_top_revenue": _on_catalog(summaries.feed_top_revenue, f"id title revenue {_CREDIBLE}"),
    "feed_monthly": _on_catalog(summaries.feed_monthly, "release_month"),
}


# --- report catalogue -----------------------------------------------------

CATALOGUE: dict[str, Query] = {
    "q01_top_rated": _on_catalog(catalogue.top_rated, "id title vote_average vote_count release_year"),
    "q01_top10_per_decade": _on_catalog(
        catalogue.top_rated_per_decade, "id title vote_average vote_count release_decade"
    ),
    "q02_top_revenue": _on_catalog(
        catalogue.top_revenue, f"id title revenue budget profit release_year {_CREDIBLE}"
    ),
    "q02_top_roi": _on_catalog(
        catalogue.top_roi, f"id title budget revenue roi release_year {_CREDIBLE}"
    ),
    "q02_yearly_money": _on_catalog(catalogue.yearly_money, f"release_year revenue budget {_CREDIBLE}"),
    "q02_flops": _on_catalog(
        catalogue.flops, f"id title budget revenue profit release_year {_CREDIBLE}"
    ),
    "q03_primary_genre_count": _on_catalog(catalogue.primary_genre_count, "primary_genre"),
    "q03_genre_stats": _on_catalog(catalogue.genre_stats, "genres vote_count vote_average", min_rows=7_000),
    "q03_genre_revenue": _on_catalog(catalogue.genre_revenue, f"genres revenue {_CREDIBLE}", min_rows=6_500),
    "q04_top_languages": _on_catalog(catalogue.top_languages, "original_language", n=3),
    "q04_language_rating": _on_catalog(
        catalogue.language_rating, "original_language vote_average vote_count", min_rows=LANGUAGE_ROWS
    ),
    "q04_top_countries": _on_catalog(catalogue.top_countries, "production_countries"),
    "q05_runtime_category": _on_catalog(catalogue.runtime_categories, "runtime vote_average"),
    "q05_runtime_range": _on_catalog(catalogue.runtime_ranges, "runtime vote_average vote_count"),
    "q05_longest": _on_catalog(catalogue.longest, "id title runtime vote_average release_year"),
    "q06_per_year": _on_catalog(catalogue.per_year, "release_year"),
    "q06_most_popular_per_year": _on_catalog(
        catalogue.most_popular_per_year, "id title popularity release_year", n=5
    ),
    "q06_per_month": _on_catalog(catalogue.per_month, "release_month"),
    "q07_title_search": _on_catalog(
        catalogue.title_search, "id title vote_average vote_count release_year overview", phrase=TITLE_PHRASE
    ),
    "q07_overview_search": _on_catalog(
        catalogue.overview_search, "id title vote_average release_year overview", phrase=OVERVIEW_PHRASE
    ),
    "q07_longest_titles": _on_catalog(catalogue.longest_titles, "id title release_year"),
    "q07_keyword_search": _on_catalog(
        catalogue.keyword_search, "id title keywords vote_average vote_count release_year", phrase=KEYWORD_PHRASE
    ),
    "q08_above_average": _on_catalog(
        catalogue.above_average, "id title vote_average vote_count release_year"
    ),
    "q08_language_top": _on_catalog(
        catalogue.top_per_language, "id title original_language vote_average vote_count", n=3
    ),
    "q08_revenue_percentile": _on_catalog(catalogue.revenue_percentile, f"id title revenue {_CREDIBLE}"),
    "q09_rank_dense_rank": _on_catalog(catalogue.rank_and_dense_rank, "id title vote_average vote_count"),
    "q09_genre_rank": _on_catalog(catalogue.genre_rank, f"id title primary_genre revenue {_CREDIBLE}"),
    "q09_top_per_year": _on_catalog(
        catalogue.top_per_year, "id title release_year vote_average vote_count", n=5
    ),
    "q09_decade_dense_top3": _on_catalog(
        catalogue.decade_top3, "id title release_decade vote_average vote_count"
    ),
    "q09_lead_revenue": _on_catalog(catalogue.next_revenue, f"id title primary_genre revenue {_CREDIBLE}"),
    "q09_lag_growth": _on_catalog(
        catalogue.revenue_growth, f"id title primary_genre release_date revenue {_CREDIBLE}"
    ),
    "q09_language_windows": _on_catalog(
        catalogue.language_popularity, "id title original_language popularity vote_count"
    ),
}

EARLY: dict[str, Query] = {
    "l_top_rated_dates": _on_catalog(
        catalogue.top_rated, "id title vote_average vote_count release_date", when="release_date"
    ),
    "l_top10_per_decade": _on_catalog(
        early.top_rated_per_decade, "id title vote_average vote_count release_date"
    ),
    "l_top_revenue_any": _on_catalog(early.top_revenue_any, "id title revenue budget release_date"),
    "l_roi_inline": _on_catalog(early.roi_inline, "id title budget revenue release_date"),
    "l_yearly_money_any": _on_catalog(early.yearly_money_any, "revenue budget release_date"),
    "l_flops_loss": _on_catalog(early.biggest_losses, "id title budget revenue release_date"),
    "l_tracked_genre_count": _on_catalog(early.listed_genre_count, "genres", names=LISTED_TAGS),
    "l_tracked_genre_rating": _on_catalog(
        early.listed_genre_rating, "genres vote_average vote_count", names=LISTED_TAGS
    ),
    "l_tracked_genre_revenue": _on_catalog(early.listed_genre_revenue, "genres revenue", names=LISTED_TAGS),
    "l_languages_nonnull": _on_catalog(early.top_languages, "original_language", n=3),
    "l_language_rating": _on_catalog(
        catalogue.language_rating, "original_language vote_average vote_count", min_rows=LANGUAGE_ROWS
    ),
    "l_countries_nonempty": _on_catalog(early.top_countries, "production_countries"),
    "l_runtime_category": _on_catalog(catalogue.runtime_categories, "runtime vote_average"),
    "l_runtime_range_revenue": _on_catalog(
        early.runtime_ranges_with_revenue, "runtime vote_average vote_count revenue"
    ),
    "l_longest_capped": _on_catalog(early.longest_capped, "id title runtime vote_average release_date"),
    "l_shortest_features": _on_catalog(early.shortest_features, "id title runtime vote_average release_date"),
    "l_per_year": _on_catalog(early.per_year, "release_date"),
    "l_most_popular_per_year": _on_catalog(early.most_popular_per_year, "id title popularity release_date", n=5),
    "l_month_name": _on_catalog(early.per_month_name, "release_date"),
    "l_title_search": _on_catalog(
        catalogue.title_search, "id title vote_average vote_count release_date overview",
        phrase=TITLE_PHRASE, when="release_date",
    ),
    "l_overview_search": _on_catalog(
        catalogue.overview_search, "id title vote_average release_date overview",
        phrase=OVERVIEW_PHRASE, when="release_date",
    ),
    "l_keyword_search": _on_catalog(
        catalogue.keyword_search, "id title keywords vote_average vote_count release_date",
        phrase=KEYWORD_PHRASE, when="release_date",
    ),
    "l_longest_titles": _on_catalog(early.longest_titles, "id title release_date"),
    "l_shortest_titles": _on_catalog(early.shortest_titles, "id title vote_average release_date"),
    "l_above_average": _on_catalog(
        catalogue.above_average, "id title vote_average vote_count release_date", when="release_date"
    ),
    "l_language_top": _on_catalog(
        catalogue.top_per_language, "id title original_language vote_average vote_count", n=3
    ),
    "l_revenue_percentile": _on_catalog(early.revenue_percentile, "id title revenue"),
    "l_profit_top10": _on_catalog(early.top_revenue_with_profit, "id title revenue budget"),
    "l_top_popular": _on_catalog(early.top_popular, "id title popularity vote_average release_date"),
    "l_top_profit_pct": _on_catalog(
        early.top_profit_percent, "id title budget revenue", min_budget=100_000.0
    ),
    "l_status_distribution": _on_catalog(early.status_distribution, "status"),
}


# --- slices ---------------------------------------------------------------

_SELECTED = "release_year vote_count genres original_language"


def _on_selection(panel: Callable[[DataFrame], DataFrame], columns: str) -> Query:
    names = dict.fromkeys(f"{_SELECTED} {columns}".split())
    return _on_catalog(lambda rows: panel(slices.select(rows, SELECTION).select(*names)), " ".join(names))


SLICES: dict[str, Query] = {
    "slice_bounds": _on_catalog(slices.bounds, "release_year"),
    "slice_genre_domain": _on_catalog(slices.genre_domain, "genres"),
    "slice_language_domain": _on_catalog(slices.language_domain, "original_language", n=3),
    "slice_filter": _on_selection(lambda rows: rows, "id title"),
    "slice_kpis": _on_selection(slices.kpis, "vote_average runtime revenue has_financials"),
    "slice_per_year": _on_selection(slices.per_year, ""),
    "slice_rating_histogram": _on_selection(slices.rating_histogram, "vote_average"),
    "slice_top_genres": _on_selection(lambda rows: slices.top_genres(rows, n=4), ""),
    "slice_money_trend": _on_selection(_rounded(slices.money_trend, avg_revenue=4, avg_budget=4), "revenue budget has_financials"),
    "slice_top_rated": _on_selection(slices.top_rated, "id title vote_average primary_genre"),
    "slice_top_grossing": _on_selection(
        slices.top_grossing, "id title revenue budget profit has_financials"
    ),
}


_CUBE_COLUMNS = (
    "id", "title", "release_year", "original_language", "genres", "vote_count", "vote_average", "runtime", "revenue", "budget",
    "has_financials", "primary_genre", "profit",
)


def _on_cube(panel: Callable[[cube.Cube], DataFrame]) -> Query:
    """A panel over the cells of the whole catalog, which are written first."""
    return lambda spark, sf_dir: panel(cube.build(catalog(spark, sf_dir, *_CUBE_COLUMNS), files.shared_folder(spark)))


CUBE: dict[str, Query] = {
    "cube_bounds": _on_cube(lambda c: c.bounds()),
    "cube_genre_domain": _on_cube(lambda c: c.genre_domain()),
    "cube_language_domain": _on_cube(lambda c: c.language_domain(n=3)),
    "cube_kpis": _on_cube(lambda c: c.kpis(SELECTION)),
    "cube_per_year": _on_cube(lambda c: c.per_year(SELECTION)),
    "cube_rating_histogram": _on_cube(lambda c: c.rating_histogram(SELECTION)),
    "cube_top_genres": _on_cube(lambda c: c.top_genres(SELECTION, n=4)),
    "cube_money_trend": _on_cube(lambda c: _rounded(lambda rows: rows, avg_revenue=4, avg_budget=4)(c.money_trend(SELECTION))),
    "cube_top_rated": _on_cube(lambda c: c.top_rated(SELECTION)),
    "cube_top_grossing": _on_cube(lambda c: c.top_grossing(SELECTION)),
}


def _searched(report: Callable[..., DataFrame], column: str, phrase: str) -> Query:
    """A search report over the candidates of a trigram index of the whole catalog."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalog(spark, sf_dir, "id", "title", "vote_average", "vote_count", "release_year", "overview", "keywords")
        index = trigrams.build(rows, ("title", "overview", "keywords"), files.shared_folder(spark))
        return report(index.candidates(column, phrase), phrase=phrase)

    return run


def _sink_clustered(spark, sf_dir):
    path = files.shared_folder(spark)
    clustered.write_clustered(cleaning.clean(raw_catalog(spark, sf_dir), LIMITS), path)
    return files.read_clean(spark, path, columns=None)


def _run_eda_shared(spark, sf_dir):
    return _common(summaries.run_eda_shared(_stored_catalog(spark, sf_dir), files.shared_folder(spark)))


INDEXES: dict[str, Query] = {
    "dq_unique_bitmap": _on_raw(lambda raw: quality.check_unique(cleaning.typed(raw, "id")), "id"),
    "run_eda_shared": _run_eda_shared,
    "search_title": _searched(catalogue.title_search, "title", TITLE_PHRASE),
    "search_overview": _searched(catalogue.overview_search, "overview", OVERVIEW_PHRASE),
    "search_keywords": _searched(catalogue.keyword_search, "keywords", KEYWORD_PHRASE),
    "sink_clustered": _sink_clustered,
    "heavy_languages": _on_catalog(lambda rows: heavy.top_counts(rows, "original_language", 3), "original_language"),
    "heavy_countries": _on_catalog(
        lambda rows: heavy.top_counts(rows.filter(F.col("production_countries") != cleaning.UNKNOWN), "production_countries", 15),
        "production_countries",
    ),
    "exact_median_revenue": _on_catalog(lambda rows: median.exact_median(rows, "revenue", small=1000), "revenue"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre statistics over the fully cleaned table."""
    return summaries.genre_stats(cleaning.clean(raw_catalog(spark, sf_dir), LIMITS))


def queries() -> dict[str, Query]:
    return {**FILES, **CLEANING, **QUALITY, **SUMMARIES, **CATALOGUE, **EARLY, **SLICES, **CUBE, **INDEXES}
