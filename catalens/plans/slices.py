"""Interactive slice and dice: one filter, then small panels over the selection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.functions import buckets, rules
from catalens.operators.median import aggregate_with_median
from catalens.operators.tags import explode_tags
from catalens.operators.topk import descending, top_n
from catalens.params import ReportRules, Slice
from catalens.plans.summaries import DEFAULT, credible_financials

# Rating scale and number of histogram bins.
RATING_LOW, RATING_HIGH, RATING_BINS = 0, 10, 40


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("release_year").alias("year_min"), F.max("release_year").alias("year_max"))


def genre_domain(rows: DataFrame) -> DataFrame:
    return explode_tags(rows.select("genres")).select("genre").distinct().orderBy("genre")


def language_domain(rows: DataFrame, n: int = 20) -> DataFrame:
    counts = (
        rows.filter(F.col("original_language").isNotNull())
        .groupBy("original_language")
        .agg(F.count("*").alias("movie_count"))
    )
    return top_n(counts, descending("movie_count", "original_language"), n).select("original_language")


def select(rows: DataFrame, chosen: Slice = Slice()) -> DataFrame:
    """Rows of the chosen years, votes, genres (any of them) and languages.

    A genre matches as a case-sensitive part of the genre text.
    """
    year = F.col("release_year")
    picked = rows.filter(F.col("vote_count") >= chosen.min_votes)
    if chosen.first_year is not None:
        picked = picked.filter(year >= chosen.first_year)
    if chosen.last_year is not None:
        picked = picked.filter(year <= chosen.last_year)
    if chosen.genres:
        picked = picked.filter(reduce(or_, [F.col("genres").contains(g) for g in chosen.genres]))
    if chosen.languages:
        picked = picked.filter(F.col("original_language").isin(*chosen.languages))
    return picked


def kpis(selected: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """Count, mean rating, median runtime and credible revenue of the selection."""
    revenue = F.when(rules.credible(limits.financial_votes), F.col("revenue"))
    return aggregate_with_median(selected, "runtime", "median_runtime", [
        F.count("*").alias("movie_count"),
        F.round(F.avg("vote_average"), 2).alias("avg_rating"),
        F.round(F.sum(revenue) / 1e9, 1).alias("total_revenue_b"),
    ]).withColumn("median_runtime", F.round("median_runtime", 0))


def per_year(selected: DataFrame) -> DataFrame:
    return (
        selected.filter(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(F.count("*").alias("count"))
        .orderBy("release_year")
    )


def rating_histogram(selected: DataFrame) -> DataFrame:
    """Rows per rating bin; a rating of 10 falls into the last bin."""
    width = (RATING_HIGH - RATING_LOW) / RATING_BINS
    bin_number = buckets.histogram_bin(F.col("vote_average"), RATING_LOW, RATING_HIGH, RATING_BINS)
    return (
        selected.filter(F.col("vote_average").isNotNull())
        .groupBy(bin_number.alias("bin"))
        .agg(F.count("*").alias("count"))
        .select("bin", (RATING_LOW + (F.col("bin") - 1) * width).alias("from_rating"), "count")
        .orderBy("bin")
    )


def top_genres(selected: DataFrame, n: int = 12) -> DataFrame:
    counts = explode_tags(selected.select("genres")).groupBy("genre").agg(F.count("*").alias("count"))
    return top_n(counts, descending("count", "genre"), n)


def money_trend(selected: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return (
        credible_financials(selected, limits)
        .filter(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(
            F.avg("revenue").alias("avg_revenue"),
            F.avg("budget").alias("avg_budget"),
        )
        .orderBy("release_year")
    )


def top_rated(selected: DataFrame, n: int = 15) -> DataFrame:
    return top_n(selected, descending("vote_average"), n).select(
        "title", "vote_average", "vote_count", "release_year", "primary_genre"
    )


def top_grossing(selected: DataFrame, limits: ReportRules = DEFAULT, n: int = 15) -> DataFrame:
    return top_n(credible_financials(selected, limits), descending("revenue"), n).select(
        "title", "revenue", "budget", "profit", "release_year"
    )
