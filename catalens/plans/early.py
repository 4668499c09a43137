"""The earlier report set: no credibility floor, dates instead of years.

Only what the main catalogue does not already give. NULLs come last in every
ordering here too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.functions import buckets, rules
from catalens.operators.tags import per_listed_tag
from catalens.operators.topk import ascending, descending, top_n, top_n_per_group
from catalens.params import ReportRules
from catalens.plans.catalogue import mean_rating, movie_count, percentile_list, rounded_mean, voted
from catalens.plans.summaries import DEFAULT, reliable_ratings


def _earning(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("revenue") > 0)


def _both_known(rows: DataFrame) -> DataFrame:
    return rows.filter(rules.both_known(F.col("revenue"), F.col("budget")))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("release_date").isNotNull())


# --- ratings and money ----------------------------------------------------


def top_rated_per_decade(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 10) -> DataFrame:
    dated = _dated(voted(rows, limits.top_rated_votes))
    dated = dated.withColumn("decade", rules.decade(F.year("release_date")))
    best = top_n_per_group(dated, "decade", descending("vote_average"), n, "rank")
    return best.select("title", "vote_average", "vote_count", "release_date", "decade", "rank").orderBy(
        F.desc("decade"), "rank"
    )


def top_revenue_any(rows: DataFrame, n: int = 20) -> DataFrame:
    return top_n(_earning(rows), descending("revenue"), n).select(
        "title", "revenue", "budget", "release_date"
    )


def roi_inline(rows: DataFrame, n: int = 20) -> DataFrame:
    roi = rules.return_on_budget(F.col("revenue"), F.col("budget"), 2)
    return top_n(_both_known(rows).withColumn("roi", roi), descending("roi"), n).select(
        "title", "budget", "revenue", "roi", "release_date"
    )


def yearly_money_any(rows: DataFrame) -> DataFrame:
    return (
        _dated(_both_known(rows))
        .groupBy(F.year("release_date").alias("release_year"))
        .agg(movie_count(), rounded_mean("revenue"), rounded_mean("budget"))
        .orderBy("release_year")
    )


def biggest_losses(rows: DataFrame, n: int = 10) -> DataFrame:
    lost = _both_known(rows).filter(F.col("revenue") < F.col("budget"))
    return top_n(
        lost.withColumn("loss", F.col("budget") - F.col("revenue")), descending("loss"), n
    ).select("title", "budget", "revenue", "loss", "release_date")


def top_revenue_with_profit(rows: DataFrame, n: int = 10) -> DataFrame:
    best = top_n(_both_known(rows), descending("revenue"), n)
    return best.select("title", "revenue", "budget", (F.col("revenue") - F.col("budget")).alias("profit"))


def top_profit_percent(rows: DataFrame, min_budget: float = 1_000_000.0, n: int = 10) -> DataFrame:
    funded = _both_known(rows).filter(F.col("budget") >= min_budget)
    pct = rules.profit_percent(F.col("revenue"), F.col("budget"))
    return top_n(funded.withColumn("profit_pct", pct), descending("profit_pct"), n).select(
        "title", "budget", "revenue", "profit_pct"
    )


def revenue_percentile(rows: DataFrame, n: int = 30) -> DataFrame:
    return percentile_list(_earning(rows), n)


# --- listed genres, by substring ------------------------------------------


def listed_genre_count(rows: DataFrame, names: Iterable[str] = DEFAULT.tracked_genres) -> DataFrame:
    counted = per_listed_tag(rows, names, {"count": F.count})
    return counted.orderBy(F.desc("count"), "genre")


def listed_genre_rating(
    rows: DataFrame,
    names: Iterable[str] = DEFAULT.rated_genres,
    limits: ReportRules = DEFAULT,
    n: int = 5,
) -> DataFrame:
    rated = per_listed_tag(reliable_ratings(rows, limits), names, {
        "avg_rating": lambda hit: F.round(F.avg(F.when(hit, F.col("vote_average"))), 2),
        "movie_count": F.count,
    })
    return top_n(rated, descending("avg_rating", "genre"), n)


def listed_genre_revenue(rows: DataFrame, names: Iterable[str] = DEFAULT.grossing_genres) -> DataFrame:
    earned = per_listed_tag(_earning(rows), names, {
        "avg_revenue": lambda hit: F.round(F.avg(F.when(hit, F.col("revenue"))), 0),
    })
    return earned.orderBy(*descending("avg_revenue", "genre"))


# --- languages and countries ----------------------------------------------


def top_languages(rows: DataFrame, n: int = 15) -> DataFrame:
    known = rows.filter(F.col("original_language").isNotNull())
    return top_n(
        known.groupBy("original_language").agg(movie_count()), descending("movie_count", "original_language"), n
    )


def top_countries(rows: DataFrame, n: int = 15) -> DataFrame:
    known = rows.filter(F.col("production_countries") != "")
    return top_n(
        known.groupBy("production_countries").agg(movie_count()), descending("movie_count", "production_countries"), n
    )


def status_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(movie_count()).orderBy(*descending("movie_count", "status"))


# --- runtimes -------------------------------------------------------------


def runtime_ranges_with_revenue(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return (
        reliable_ratings(rows, limits)
        .filter(F.col("runtime") > 0)
        .groupBy(buckets.runtime_range(F.col("runtime")).alias("runtime_range"))
        .agg(movie_count(), mean_rating(), rounded_mean("revenue"))
        .orderBy(F.col("runtime_range").asc_nulls_last())
    )


def longest_capped(rows: DataFrame, cap: float = 1000, n: int = 10) -> DataFrame:
    plausible = rows.filter((F.col("runtime") > 0) & (F.col("runtime") < cap))
    return top_n(plausible, descending("runtime"), n).select("title", "runtime", "vote_average", "release_date")


def shortest_features(rows: DataFrame, floor: float = 40, n: int = 10) -> DataFrame:
    features = rows.filter(F.col("runtime") >= floor)
    return top_n(features, ascending("runtime"), n).select("title", "runtime", "vote_average", "release_date")


# --- popularity and trends ------------------------------------------------


def top_popular(rows: DataFrame, n: int = 20) -> DataFrame:
    return top_n(rows, descending("popularity"), n).select(
        "title", "popularity", "vote_average", "release_date"
    )


def per_year(rows: DataFrame) -> DataFrame:
    years = _dated(rows).groupBy(F.year("release_date").alias("release_year"))
    return years.agg(movie_count()).orderBy("release_year")


def most_popular_per_year(rows: DataFrame, n: int = 30) -> DataFrame:
    known = _dated(rows).filter(F.col("popularity").isNotNull())
    known = known.withColumn("release_year", F.year("release_date"))
    first = top_n_per_group(known, "release_year", descending("popularity"), 1, "rank")
    return top_n(first, descending("release_year"), n).select("title", "popularity", "release_year", "rank")


def per_month_name(rows: DataFrame) -> DataFrame:
    month, name = F.month("release_date"), F.date_format("release_date", "MMMM")
    return (
        _dated(rows)
        .groupBy(month.alias("release_month"), name.alias("month_name"))
        .agg(movie_count())
        .orderBy(F.desc("movie_count"), "release_month")
    )


# --- titles ---------------------------------------------------------------


def longest_titles(rows: DataFrame, n: int = 15) -> DataFrame:
    sized = rows.filter(F.col("title").isNotNull()).withColumn("title_length", F.length("title"))
    return top_n(sized, descending("title_length"), n).select("title", "title_length", "release_date")


def shortest_titles(rows: DataFrame, n: int = 15) -> DataFrame:
    sized = rows.withColumn("title_length", F.length("title")).filter(F.col("title_length") >= 1)
    return top_n(sized, ascending("title_length"), n).select(
        "title", "title_length", "vote_average", "release_date"
    )
