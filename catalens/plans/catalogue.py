"""The report catalogue over the clean table.

Every report is a function of the frame, the limits and, where the report is a
list, its length. Orderings end with the id so that ties resolve the same way
on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import buckets
from catalens.functions.parse import trim_spaces
from catalens.operators import ranking
from catalens.operators.cleaning import UNKNOWN
from catalens.operators.tags import explode_tags
from catalens.operators.topk import ascending, descending, top_n, top_n_per_group
from catalens.params import ReportRules
from catalens.plans.summaries import DEFAULT, credible_financials, reliable_ratings

def movie_count() -> Column:
    return F.count("*").alias("movie_count")


def mean_rating() -> Column:
    return F.round(F.avg("vote_average"), 2).alias("avg_rating")


def voted(rows: DataFrame, floor: int) -> DataFrame:
    return rows.filter(F.col("vote_count") >= floor)


def containing(rows: DataFrame, column: str, phrase: str) -> DataFrame:
    """Rows whose text contains the phrase as it is (no wildcards), ignoring case."""
    return rows.filter(F.lower(column).contains(phrase.lower()))


def rounded_mean(column: str) -> Column:
    return F.round(F.avg(column)).alias(f"avg_{column}")


# --- ratings --------------------------------------------------------------


def top_rated(
    rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 20, when: str = "release_year"
) -> DataFrame:
    best = top_n(voted(rows, limits.top_rated_votes), descending("vote_average"), n)
    return best.select("title", "vote_average", "vote_count", when)


def top_rated_per_decade(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 10) -> DataFrame:
    best = top_n_per_group(
        voted(rows, limits.top_rated_votes), "release_decade", descending("vote_average"), n
    )
    return best.orderBy(F.col("release_decade").desc_nulls_last(), "rn").select(
        "title", "vote_average", "vote_count", "release_decade"
    )


# --- money ----------------------------------------------------------------


def top_revenue(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 20) -> DataFrame:
    return top_n(credible_financials(rows, limits), descending("revenue"), n).select(
        "title", "revenue", "budget", "profit", "release_year"
    )


def top_roi(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 20) -> DataFrame:
    funded = credible_financials(rows, limits).filter(F.col("budget") >= limits.real_budget)
    return top_n(funded, descending("roi"), n).select("title", "budget", "revenue", "roi", "release_year")


def yearly_money(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return (
        credible_financials(rows, limits)
        .groupBy("release_year")
        .agg(movie_count(), rounded_mean("revenue"), rounded_mean("budget"))
        .orderBy(F.col("release_year").asc_nulls_last())
    )


def flops(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 10) -> DataFrame:
    lost = credible_financials(rows, limits).filter(F.col("profit") < 0)
    return top_n(lost, ascending("profit"), n).select("title", "budget", "revenue", "profit", "release_year")


# --- genres ---------------------------------------------------------------


def primary_genre_count(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("primary_genre") != "")
        .groupBy("primary_genre")
        .agg(movie_count())
        .orderBy(F.desc("movie_count"), "primary_genre")
    )


def genre_stats(rows: DataFrame, limits: ReportRules = DEFAULT, min_rows: int = 100) -> DataFrame:
    reliable = F.when(F.col("vote_count") >= limits.reliable_votes, F.col("vote_average"))
    return (
        explode_tags(rows.select("genres", reliable.alias("rating")), keep_empty=True, trim=trim_spaces)
        .groupBy("genre")
        .agg(movie_count(), F.round(F.avg("rating"), 2).alias("avg_rating"))
        .filter(F.col("movie_count") >= min_rows)
        .orderBy(F.desc("movie_count"), "genre")
    )


def genre_revenue(rows: DataFrame, limits: ReportRules = DEFAULT, min_rows: int = 50) -> DataFrame:
    earning = credible_financials(rows, limits).select("genres", "revenue")
    return (
        explode_tags(earning, keep_empty=True, trim=trim_spaces)
        .groupBy("genre")
        .agg(rounded_mean("revenue"), movie_count())
        .filter(F.col("movie_count") >= min_rows)
        .select("genre", "avg_revenue")
        .orderBy(F.desc("avg_revenue"), "genre")
    )


# --- languages and countries ----------------------------------------------


def top_languages(rows: DataFrame, n: int = 15) -> DataFrame:
    counts = rows.groupBy("original_language").agg(movie_count())
    return top_n(counts, descending("movie_count", "original_language"), n)


def language_rating(rows: DataFrame, limits: ReportRules = DEFAULT, min_rows: int = 100) -> DataFrame:
    return (
        voted(rows, limits.some_votes)
        .groupBy("original_language")
        .agg(movie_count(), mean_rating())
        .filter(F.col("movie_count") >= min_rows)
        .orderBy(*descending("avg_rating", "original_language"))
    )


def top_countries(rows: DataFrame, n: int = 15) -> DataFrame:
    """The whole country text is the key: joint productions count as their own."""
    known = rows.filter(F.col("production_countries") != UNKNOWN)
    counts = known.groupBy("production_countries").agg(movie_count())
    return top_n(counts, descending("movie_count", "production_countries"), n)


# --- runtimes -------------------------------------------------------------


def runtime_categories(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("runtime") > 0)
        .groupBy(buckets.runtime_category(F.col("runtime")).alias("runtime_category"))
        .agg(movie_count(), mean_rating())
        .orderBy(*descending("movie_count", "runtime_category"))
    )


def runtime_ranges(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return (
        reliable_ratings(rows, limits)
        .filter(F.col("runtime") > 0)
        .groupBy(buckets.runtime_range(F.col("runtime")).alias("runtime_range"))
        .agg(movie_count(), mean_rating())
        .orderBy(F.col("runtime_range").asc_nulls_last())
    )


def longest(rows: DataFrame, n: int = 10) -> DataFrame:
    return top_n(rows.filter(F.col("runtime") > 0), descending("runtime"), n).select(
        "title", "runtime", "vote_average", "release_year"
    )


# --- popularity and trends ------------------------------------------------


def per_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("release_year").agg(movie_count()).orderBy(F.col("release_year").asc_nulls_last())


def most_popular_per_year(rows: DataFrame, n: int = 30) -> DataFrame:
    known = rows.filter(F.col("popularity").isNotNull())
    first = top_n_per_group(known, "release_year", descending("popularity"), 1)
    return top_n(first, descending("release_year"), n).select("title", "popularity", "release_year")


def per_month(rows: DataFrame) -> DataFrame:
    return rows.groupBy("release_month").agg(movie_count()).orderBy(*descending("movie_count", "release_month"))


# --- text search ----------------------------------------------------------


def title_search(
    rows: DataFrame, phrase: str = "war", limits: ReportRules = DEFAULT, n: int = 20, when: str = "release_year"
) -> DataFrame:
    hits = voted(containing(rows, "title", phrase), limits.financial_votes)
    return top_n(hits, descending("vote_average"), n).select("title", "vote_average", when, "overview")


def overview_search(
    rows: DataFrame, phrase: str = "artificial intelligence", n: int = 20, when: str = "release_year"
) -> DataFrame:
    hits = containing(rows, "overview", phrase)
    return top_n(hits, descending("vote_average"), n).select("title", "vote_average", when)


def longest_titles(rows: DataFrame, n: int = 15) -> DataFrame:
    sized = rows.withColumn("title_length", F.length("title"))
    return top_n(sized, descending("title_length"), n).select("title", "title_length", "release_year")


def keyword_search(
    rows: DataFrame, phrase: str = "robot", limits: ReportRules = DEFAULT, n: int = 20, when: str = "release_year"
) -> DataFrame:
    hits = voted(containing(rows, "keywords", phrase), limits.reliable_votes)
    return top_n(hits, descending("vote_average"), n).select("title", "keywords", "vote_average", when)


# --- comparisons ----------------------------------------------------------


def above_average(
    rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 20, when: str = "release_year"
) -> DataFrame:
    """Best rated rows among those above the mean rating of the same selection."""
    known = voted(rows, limits.well_voted)
    mean = known.agg(F.avg("vote_average")).scalar()
    return top_n(known.filter(F.col("vote_average") > mean), descending("vote_average"), n).select(
        "title", "vote_average", when
    )


def top_per_language(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 20) -> DataFrame:
    first = top_n_per_group(
        voted(rows, limits.financial_votes), "original_language", descending("vote_average"), 1
    )
    return top_n(first, descending("vote_average"), n).select(
        "title", "original_language", "vote_average", "vote_count"
    )


def revenue_percentile(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 30) -> DataFrame:
    return percentile_list(credible_financials(rows, limits), n)


def percentile_list(earning: DataFrame, n: int) -> DataFrame:
    placed = ranking.percent_rank_head(earning, "revenue", n, "share")
    return placed.select(
        "title", "revenue", F.round(F.col("share") * 100, 1).alias("revenue_percentile")
    ).orderBy(F.desc("revenue"))


# --- window reports -------------------------------------------------------


def rank_and_dense_rank(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 25) -> DataFrame:
    return ranking.ranked_head(voted(rows, limits.well_voted), "vote_average", n).select(
        "title", "vote_average", "vote_count",
        F.col("rank").alias("rank_with_gaps"), F.col("dense_rank").alias("dense_rank_no_gaps"),
    )


def genre_rank(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 5) -> DataFrame:
    ranked = ranking.rank_per_group(credible_financials(rows, limits), "primary_genre", "revenue", n)
    return ranked.select("title", "primary_genre", "revenue", F.col("rank").alias("genre_rank")).orderBy(
        F.col("primary_genre").asc_nulls_last(), "genre_rank"
    )


def top_per_year(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 30) -> DataFrame:
    first = top_n_per_group(
        voted(rows, limits.well_voted), "release_year", descending("vote_average"), 1, "yr_rank"
    )
    return top_n(first, descending("release_year"), n).select(
        "title", "release_year", "vote_average", "yr_rank"
    )


def decade_top3(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 3) -> DataFrame:
    ranked = ranking.rank_per_group(
        voted(rows, limits.top_rated_votes), "release_decade", "vote_average", n, "dense_rank"
    )
    return ranked.select("title", "release_decade", "vote_average", F.col("dense_rank").alias("dr")).orderBy(
        F.col("release_decade").desc_nulls_last(), "dr"
    )


def next_revenue(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 40) -> DataFrame:
    credible = credible_financials(rows, limits)
    return ranking.next_in_group(
        credible, "primary_genre", descending("revenue"), "revenue", n, "next_revenue"
    ).select("title", "primary_genre", "revenue", "next_revenue")


def revenue_growth(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 40) -> DataFrame:
    credible = credible_financials(rows, limits)
    return ranking.previous_in_group(
        credible, "primary_genre", ascending("release_date"), "revenue", n, "previous"
    ).select(
        "title", "primary_genre", "release_date", "revenue",
        (F.col("revenue") - F.col("previous")).alias("growth_vs_prev"),
    )


def language_popularity(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 50) -> DataFrame:
    return ranking.ranked_head_per_group(
        voted(rows, limits.well_voted), "original_language", "popularity", n, "popularity"
    ).select(
        "title", "original_language", "popularity",
        F.col("dense_rank").alias("lang_rank"),
        F.round("group_mean", 2).alias("lang_avg_popularity"),
    ).orderBy(F.col("original_language").asc_nulls_last(), "lang_rank")
