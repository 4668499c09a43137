"""The summary tables of the batch report, its key figures and chart feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import buckets, rules
from catalens.functions.parse import trim_white_space
from catalens.operators.median import aggregate_with_median
from catalens.operators.tags import explode_tags
from catalens.operators.topk import descending, top_n, top_n_per_group
from catalens.params import ReportRules
from catalens.sources.files import materialise

DEFAULT = ReportRules()


def credible_financials(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """Rows whose money columns can be trusted.

    Anybody can enter a fake revenue, but nobody votes for such entries.
    """
    return rows.filter(rules.credible(limits.financial_votes))


def reliable_ratings(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return rows.filter(F.col("vote_count") >= limits.reliable_votes)


def _if_credible(value: str, limits: ReportRules) -> Column:
    return F.when(rules.credible(limits.financial_votes), F.col(value))


def summary_kpis(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """One row of headline figures; all NULL or 0 for an empty table."""
    revenue = F.coalesce(F.sum(_if_credible("revenue", limits)), F.lit(0.0))
    return aggregate_with_median(rows, "runtime", "median_runtime", [
        F.count("*").alias("total_movies"),
        F.min("release_year").alias("year_min"),
        F.max("release_year").alias("year_max"),
        F.round(F.avg("vote_average"), 2).alias("avg_rating"),
        F.count_if(rules.credible(limits.financial_votes)).alias("movies_with_financials"),
        F.round(revenue / 1e9, 1).alias("total_revenue_b"),
    ])


def top_rated(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    voted = rows.filter(F.col("vote_count") >= limits.top_rated_votes)
    return top_n(voted, descending("vote_average"), limits.top_n).select(
        "title", "vote_average", "vote_count", "release_year"
    )


def top_revenue(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return top_n(credible_financials(rows, limits), descending("revenue"), limits.top_n).select(
        "title", "revenue", "budget", "profit", "release_year"
    )


def top_roi(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    funded = credible_financials(rows, limits).filter(F.col("budget") >= limits.real_budget)
    return top_n(funded, descending("roi"), limits.top_n).select(
        "title", "budget", "revenue", "roi", "release_year"
    )


def genre_stats(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """Rows per genre, and the mean rating of those with enough votes (or NULL)."""
    reliable = F.when(F.col("vote_count") >= limits.reliable_votes, F.col("vote_average"))
    # Only two narrow columns travel with the exploded tokens.
    rated = rows.select("genres", reliable.alias("rating"))
    return (
        explode_tags(rated)
        .groupBy("genre")
        .agg(F.count("*").alias("movie_count"), F.round(F.avg("rating"), 2).alias("avg_rating"))
        .orderBy(F.desc("movie_count"), "genre")
    )


def yearly_trend(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """Rows per year over all rows, mean money over the credible ones."""
    return (
        rows.filter(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(
            F.count("*").alias("movie_count"),
            F.avg(_if_credible("revenue", limits)).alias("avg_revenue"),
            F.avg(_if_credible("budget", limits)).alias("avg_budget"),
        )
        .orderBy("release_year")
    )


def runtime_buckets(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    position = buckets.runtime_bucket_position(F.col("runtime"))
    return (
        reliable_ratings(rows, limits)
        .filter(F.col("runtime") > 0)
        .groupBy(position.alias("position"))
        .agg(F.count("*").alias("movie_count"), F.round(F.avg("vote_average"), 2).alias("avg_rating"))
        .orderBy("position")
        .select(buckets.runtime_bucket_label(F.col("position")).alias("bucket"), "movie_count", "avg_rating")
    )


def language_stats(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    """The most frequent languages with the mean rating of all their rows."""
    languages = (
        rows.filter(F.col("original_language").isNotNull())
        .groupBy("original_language")
        .agg(F.count("*").alias("movie_count"), F.round(F.avg("vote_average"), 2).alias("avg_rating"))
    )
    return top_n(
        languages,
        descending("movie_count", tiebreak="original_language"),
        max(limits.top_n, limits.min_language_rows),
    )


def monthly_releases(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("release_month").isNotNull())
        .groupBy("release_month")
        .agg(F.count("*").alias("movie_count"))
        .orderBy("release_month")
    )


def run_eda(rows: DataFrame, limits: ReportRules = DEFAULT) -> dict[str, DataFrame]:
    """All summary tables by name, as plans: nothing runs until they are written."""
    return {
        "top_rated": top_rated(rows, limits),
        "top_revenue": top_revenue(rows, limits),
        "top_roi": top_roi(rows, limits),
        "genre_stats": genre_stats(rows, limits),
        "yearly_trend": yearly_trend(rows, limits),
        "runtime_buckets": runtime_buckets(rows, limits),
        "language_stats": language_stats(rows, limits),
        "monthly_releases": monthly_releases(rows),
    }


# The lists of `run_eda`: what orders them, and their columns.
_HEADS = {
    "top_rated": ("vote_average", ("title", "vote_average", "vote_count", "release_year")),
    "top_revenue": ("revenue", ("title", "revenue", "budget", "profit", "release_year")),
    "top_roi": ("roi", ("title", "budget", "revenue", "roi", "release_year")),
}


def run_eda_shared(rows: DataFrame, folder: str, limits: ReportRules = DEFAULT) -> dict[str, DataFrame]:
    """The tables of `run_eda` from two passes over the rows, which are written under `folder`.

    Every row is taken apart into one entry per table and group that it counts for, and one
    aggregate over (table, group) makes all five grouped tables. The three lists share the
    other pass, in which every task keeps its first rows of each list.
    """
    reliable = F.col("vote_count") >= limits.reliable_votes
    none = F.lit(None).cast("double")

    def entry(table: str, label: Column, rating: Column = none, revenue: Column = none, budget: Column = none) -> Column:
        fields = {"label": label.cast("string"), "rating": rating, "revenue": revenue, "budget": budget}
        return F.struct(F.lit(table).alias("table_name"), *[value.alias(name) for name, value in fields.items()])

    tags = F.transform(F.split(F.coalesce("genres", F.lit("")), ",", -1), trim_white_space)
    reliable_rating = F.when(reliable, F.col("vote_average"))
    per_tag = F.transform(F.filter(tags, lambda t: t != ""), lambda t: entry("genre_stats", t, reliable_rating))
    position = F.when(reliable & (F.col("runtime") > 0), buckets.runtime_bucket_position(F.col("runtime")))
    per_row = F.array(
        entry("yearly_trend", F.col("release_year"), none, _if_credible("revenue", limits), _if_credible("budget", limits)),
        entry("runtime_buckets", position, F.col("vote_average")),
        entry("language_stats", F.col("original_language"), F.col("vote_average")),
        entry("monthly_releases", F.col("release_month")),
    )
    entries = rows.select(F.inline(F.concat(per_tag, F.filter(per_row, lambda e: e["label"].isNotNull()))))
    groups = entries.groupBy("table_name", "label").agg(
        F.count("*").alias("movie_count"), F.round(F.avg("rating"), 2).alias("avg_rating"),
        F.avg("revenue").alias("avg_revenue"), F.avg("budget").alias("avg_budget"),
    )
    groups = materialise(groups, f"{folder}/groups")

    credible = F.coalesce(rules.credible(limits.financial_votes), F.lit(False))
    listed = {
        "top_rated": F.col("vote_count") >= limits.top_rated_votes, "top_revenue": credible, "top_roi": credible & (F.col("budget") >= limits.real_budget),
    }
    columns = dict.fromkeys(["id", *[c for _, own in _HEADS.values() for c in own]])
    heads = [
        F.when(listed[name], F.struct(F.lit(name).alias("table_name"), F.col(by).alias("value"), *[F.col(c) for c in columns]))
        for name, (by, _) in _HEADS.items()
    ]
    heads = rows.select(F.inline(F.filter(F.array(*heads), lambda h: h.isNotNull())))
    first = top_n_per_group(heads, "table_name", descending("value"), limits.top_n)
    first = materialise(first, f"{folder}/heads")

    def table(name: str, label: str, kind: str = "string") -> DataFrame:
        return groups.filter(F.col("table_name") == name).withColumn(label, F.col("label").cast(kind))

    lists = {
        name: top_n(first.filter(F.col("table_name") == name), descending("value"), limits.top_n).select(*own)
        for name, (_, own) in _HEADS.items()
    }
    rated = ("movie_count", "avg_rating")
    runtimes = table("runtime_buckets", "position", "int").orderBy("position")
    return {
        **lists,
        "genre_stats": table("genre_stats", "genre").select("genre", *rated).orderBy(F.desc("movie_count"), "genre"),
        "yearly_trend": table("yearly_trend", "release_year", "int").select("release_year", "movie_count", "avg_revenue", "avg_budget").orderBy("release_year"),
        "runtime_buckets": runtimes.select(buckets.runtime_bucket_label(F.col("position")).alias("bucket"), *rated),
        "language_stats": top_n(
            table("language_stats", "original_language").select("original_language", *rated),
            descending("movie_count", "original_language"), max(limits.top_n, limits.min_language_rows),
        ),
        "monthly_releases": table("monthly_releases", "release_month", "int").select("release_month", "movie_count").orderBy("release_month"),
    }


# --- chart feeds: the numbers behind each chart of the report --------------


def feed_movies_per_year(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(F.count("*").alias("movie_count"))
        .orderBy("release_year")
    )


def feed_money_millions(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return yearly_trend(rows, limits).select(
        "release_year",
        (F.col("avg_revenue") / 1e6).alias("avg_revenue_m"),
        (F.col("avg_budget") / 1e6).alias("avg_budget_m"),
    )


def feed_top_genres(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 12) -> DataFrame:
    return genre_stats(rows, limits).limit(n)


def feed_runtime_rating(rows: DataFrame, limits: ReportRules = DEFAULT) -> DataFrame:
    return runtime_buckets(rows, limits).select("bucket", "avg_rating")


def feed_top_revenue(rows: DataFrame, limits: ReportRules = DEFAULT, n: int = 10) -> DataFrame:
    return top_n(credible_financials(rows, limits), descending("revenue"), n).select(
        "title", (F.col("revenue") / 1e6).alias("revenue_m")
    )


def feed_monthly(rows: DataFrame) -> DataFrame:
    return monthly_releases(rows)
