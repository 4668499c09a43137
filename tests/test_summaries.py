"""Summary tables, key figures and chart feeds on the four-row frame."""

import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalens.functions import buckets
from catalens.operators.median import aggregate_with_median, exact_median
from catalens.operators.tags import explode_tags, per_listed_tag
from catalens.plans import catalogue, early, summaries


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_kpis(four):
    k = summaries.summary_kpis(four).first()
    assert (k.total_movies, k.year_min, k.year_max, k.avg_rating) == (4, 2000, 2010, 6.8)
    assert (k.movies_with_financials, k.total_revenue_b, k.median_runtime) == (2, 0.5, 107.5)


def test_kpis_of_nothing(clean_frame):
    k = summaries.summary_kpis(clean_frame()).first()
    assert tuple(k) == (0, None, None, None, 0, 0.0, None)


def test_explode(four):
    exploded = explode_tags(four)
    assert exploded.count() == 6
    assert {r.genre for r in exploded.collect()} == {"Action", "Thriller", "Comedy", "Drama"}


def test_explode_empty_and_repeated_tokens(clean_frame):
    frame = clean_frame(dict(id=1, genres="a,, a "), dict(id=2, genres=None), dict(id=3, genres=""))
    assert rows(explode_tags(frame).select("id", "genre")) == [(1, "a"), (1, "a")]
    kept = explode_tags(frame, keep_empty=True).select("id", "genre")
    assert rows(kept) == [(1, "a"), (1, ""), (1, "a"), (3, "")]


def test_top_lists(four):
    assert rows(summaries.top_revenue(four).select("title")) == [("C",), ("A",)]
    assert rows(summaries.top_rated(four).select("title")) == [("C",), ("A",)]
    roi = summaries.top_roi(four, replace(summaries.DEFAULT, financial_votes=1))
    assert rows(roi.select("title", "budget")) == [("C", 2e8), ("A", 5e5), ("D", 1e6)]
    assert all(b >= 100_000 for _, b in rows(roi.select("title", "budget")))


def test_yearly_trend(four):
    assert rows(summaries.yearly_trend(four)) == [
        (2000, 1, 1e6, 5e5), (2001, 1, None, None), (2010, 2, 5e8, 2e8),
    ]
    assert rows(summaries.feed_money_millions(four))[2] == (2010, 500.0, 200.0)
    assert rows(summaries.feed_movies_per_year(four)) == [(2000, 1), (2001, 1), (2010, 2)]


def test_genre_stats_keeps_genres_without_reliable_rating(four):
    found = {r.genre: (r.movie_count, r.avg_rating) for r in summaries.genre_stats(four).collect()}
    assert found == {"Action": (2, 7.85), "Drama": (2, 6.85), "Thriller": (1, 7.5), "Comedy": (1, None)}
    assert rows(summaries.feed_top_genres(four, n=2).select("genre")) == [("Action",), ("Drama",)]


def test_other_tables(four):
    assert rows(summaries.monthly_releases(four)) == [(1, 1), (5, 1), (7, 1), (12, 1)]
    assert rows(summaries.language_stats(four)) == [("en", 3, 7.07), ("fr", 1, 6.0)]
    assert rows(summaries.feed_top_revenue(four)) == [("C", 500.0), ("A", 1.0)]
    assert set(summaries.run_eda(four)) == {
        "top_rated", "top_revenue", "top_roi", "genre_stats", "yearly_trend", "runtime_buckets",
        "language_stats", "monthly_releases",
    }


def test_null_groups_are_dropped_in_summaries_and_kept_in_reports(clean_frame):
    frame = clean_frame(dict(id=1, release_year=2000, original_language="en"), dict(id=2))
    assert summaries.yearly_trend(frame).count() == 1
    assert summaries.language_stats(frame).count() == 1
    assert rows(catalogue.per_year(frame)) == [(2000, 1), (None, 1)]
    assert catalogue.top_languages(frame).count() == 2
    assert early.top_languages(frame).count() == 1


RUNTIMES = [0.5, 60, 60.5, 90, 90.5, 91, 120, 120.5, 150, 150.5, 180, 180.5]


def test_runtime_bucket_edges(spark):
    frame = spark.createDataFrame([(float(v),) for v in RUNTIMES], "v double")
    found = frame.select(
        buckets.runtime_bucket_label(buckets.runtime_bucket_position(F.col("v"))),
        buckets.runtime_range(F.col("v")),
        buckets.runtime_category(F.col("v")),
    )
    bucket, span, category = map(list, zip(*rows(found)))
    assert bucket == [
        "0-60", "0-60", "61-90", "61-90", "91-120", "91-120", "91-120", "121-150", "121-150", "151-180",
        "151-180", "180+",
    ]
    assert span == [
        "0-60 min", "0-60 min", None, "61-90 min", None, "91-120 min", "91-120 min", None, "121-150 min",
        None, "151-180 min", "180+ min",
    ]
    assert [c and c.split(" (")[0] for c in category] == [
        "Short", "Medium", "Medium", "Medium", None, "Long", "Long", "Long", "Long", "Very Long",
        "Very Long", "Very Long",
    ]


def test_runtime_bucket_table_is_in_bucket_order(clean_frame):
    frame = clean_frame(*[dict(id=i, runtime=r, vote_count=60, vote_average=5.0) for i, r in enumerate([200.0, 95.0, 10.0])])
    assert rows(summaries.runtime_buckets(frame)) == [("0-60", 1, 5.0), ("91-120", 1, 5.0), ("180+", 1, 5.0)]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 1001, 20_000])
def test_exact_median(spark, size):
    random.seed(size)
    data = [random.choice([None, random.uniform(-5, 5), 1.0]) for _ in range(size)]
    known = [v for v in data if v is not None]
    frame = spark.createDataFrame([(v,) for v in data], "v double").repartition(3)
    found = exact_median(frame, "v").first().median
    assert found == (statistics.median(known) if known else None)


def test_exact_median_with_a_hot_value(spark):
    frame = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double") / 9000).alias("v")
    )
    expected = frame.agg(F.median("v")).first()[0]
    assert exact_median(frame, "v").first().median == expected


def test_exact_median_narrows_the_bracket_and_ignores_nan(spark):
    nan = float("nan")
    values = [nan, None, *[float(i * i % 9973) for i in range(5_000)], nan]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    expected = statistics.median(v for v in values if v is not None and v == v)
    assert exact_median(frame, "v", small=10).first().median == expected
    assert aggregate_with_median(frame, "v", "m").first().m == expected
    few = spark.createDataFrame([(nan,), (nan,), (1.0,), (2.0,)], "v double")
    assert exact_median(few, "v").first().median == aggregate_with_median(few, "v", "m").first().m == 1.5


def test_a_bracket_that_misses_the_middle_is_widened(spark):
    frame = spark.range(4_000).select((F.col("id") * 7919 % 4001).cast("double").alias("v"))
    expected = frame.agg(F.median("v")).first()[0]
    assert exact_median(frame, "v", small=5, margin=-0.2).first().median == expected


def test_mean_money_keeps_small_large_and_missing_values(clean_frame):
    money = [1e-5, 1e19, None, 3e-5]
    frame = clean_frame(*[
        dict(id=i, release_year=2000 + (i == 1), revenue=v, budget=1.0, vote_count=500, has_financials=True)
        for i, v in enumerate(money)
    ])
    assert [r.avg_revenue for r in summaries.yearly_trend(frame).collect()] == [2e-5, 1e19]



def test_listed_tags_match_parts_and_keep_zero_counts(clean_frame):
    frame = clean_frame(
        dict(id=1, genres="Musical, Drama"), dict(id=2, genres="music"), dict(id=3, genres=None)
    )
    names = ["Music", "Drama", "Western"]
    assert rows(early.listed_genre_count(frame, names)) == [("Music", 2), ("Drama", 1), ("Western", 0)]
    plan = early.listed_genre_count(frame, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    rated = per_listed_tag(frame, names, {"n": F.count, "top": lambda hit: F.max(F.when(hit, F.col("id")))})
    assert rows(rated) == [("Music", 2, 2), ("Drama", 1, 1), ("Western", 0, None)]


def test_searches_ignore_case(clean_frame):
    frame = clean_frame(
        dict(id=1, title="Star WARS", vote_count=100, vote_average=5.0),
        dict(id=2, title="Peace", vote_count=100, vote_average=9.0),
        dict(id=3, title="war", vote_count=99, vote_average=9.0),
        columns=("id", "title", "vote_count", "vote_average", "release_year", "overview", "release_date"),
    )
    assert rows(catalogue.title_search(frame).select("title")) == [("Star WARS",)]
    assert rows(catalogue.title_search(frame, when="release_date").select("title")) == [("Star WARS",)]
    assert rows(early.shortest_titles(frame.withColumn("title", F.nullif("title", F.lit("war")))).select("title")) == [
        ("Peace",), ("Star WARS",),
    ]


def test_shared_tables_equal_the_single_ones(spark, four, clean_frame, tmp_path):
    odd = clean_frame(
        dict(id=5, genres=" ,Drama,,Drama\t", vote_count=None, runtime=0.0, release_year=None, original_language=None),
        dict(id=6, title="tie", vote_average=7.5, vote_count=2000, has_financials=True, revenue=1e6, budget=5e5, roi=2.0, release_month=5),
        dict(id=7, genres="", vote_count=60, vote_average=None, runtime=60.5, original_language="en", release_year=2000),
    )
    for number, rows in enumerate((four, four.unionByName(odd), four.limit(0))):
        shared = summaries.run_eda_shared(rows, f"{tmp_path}/{number}")
        single = summaries.run_eda(rows)
        assert shared.keys() == single.keys()
        for name in single:
            assert shared[name].dtypes == single[name].dtypes
            assert shared[name].collect() == single[name].collect(), name
