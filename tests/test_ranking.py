"""Ranks and neighbours against plain windows, with ties, NULLs and hot groups."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalens.operators import ranking
from catalens.operators.topk import ascending, descending, top_n, top_n_per_group


def data(spark, size=400, seed=1, values=25):
    """One group holds a third of the rows; values tie often; both may be NULL."""
    rng = random.Random(seed)
    rows = [
        (
            i,
            "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None]),
            rng.choice([None, *[float(v) for v in range(values)]]),
        )
        for i in range(size)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, grp string, val double").repartition(5)


def same(left, right):
    key = repr
    assert sorted(map(tuple, left.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


def by_value():
    return F.col("val").desc_nulls_last()


@pytest.mark.parametrize("size", [0, 1, 7, 400])
def test_ranked_head(spark, size):
    frame = data(spark, size)
    over = Window.orderBy(by_value())
    direct = frame.withColumns({"rank": F.rank().over(over), "dense_rank": F.dense_rank().over(over)})
    same(ranking.ranked_head(frame, "val", 25), top_n(direct, descending("val"), 25))


@pytest.mark.parametrize("kind", ["rank", "dense_rank"])
@pytest.mark.parametrize("n", [1, 3, 5])
@pytest.mark.parametrize("size", [0, 1, 400])
def test_rank_per_group(spark, kind, n, size):
    frame = data(spark, size)
    over = Window.partitionBy("grp").orderBy(by_value())
    ranked = {"rank": F.rank(), "dense_rank": F.dense_rank()}[kind].over(over)
    direct = frame.withColumn(kind, ranked).filter(F.col(kind) <= n)
    same(ranking.rank_per_group(frame, "grp", "val", n, kind), direct.select("id", "grp", "val", kind))


def test_rank_per_group_keeps_all_ties(spark):
    frame = spark.range(3000).select("id", F.lit("g").alias("grp"), F.lit(1.0).alias("val"))
    assert ranking.rank_per_group(frame, "grp", "val", 1).count() == 3000


def test_rank_per_group_shuffles_counts_not_rows(spark, tmp_path):
    data(spark, 400).write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    plan = ranking.rank_per_group(frame, "grp", "val", 3)._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    assert sum("FileScan" in line for line in lines) == 2
    by_group = [i for i, line in enumerate(lines) if re.search(r"hashpartitioning\(grp#\d+, \d+\)", line)]
    assert len(by_group) == 1  # of the counts, cut to the best n values in every task
    below = lines[by_group[0] :]
    assert any("WindowGroupLimit" in line and "Partial" in line for line in below)
    assert any("HashAggregate" in line for line in below)


@pytest.mark.parametrize("size", [0, 1, 40, 41, 400])
def test_neighbours(spark, size):
    frame = data(spark, size)
    over = Window.partitionBy("grp").orderBy(*descending("val"))
    whole = [F.col("grp").asc_nulls_last(), *descending("val")]
    lead = top_n(frame.withColumn("next", F.lead("val").over(over)), whole, 40)
    same(ranking.next_in_group(frame, "grp", descending("val"), "val", 40, "next"), lead)

    over = Window.partitionBy("grp").orderBy(*ascending("val"))
    whole = [F.col("grp").asc_nulls_last(), *ascending("val")]
    lag = top_n(frame.withColumn("prev", F.lag("val").over(over)), whole, 40)
    same(ranking.previous_in_group(frame, "grp", ascending("val"), "val", 40, "prev"), lag)


@pytest.mark.parametrize("size", [0, 1, 400])
def test_ranked_head_per_group(spark, size):
    frame = data(spark, size)
    group = Window.partitionBy("grp")
    direct = frame.withColumns({
        "dense_rank": F.dense_rank().over(group.orderBy(by_value())),
        "group_mean": F.avg("val").over(group),
    })
    direct = top_n(direct, [F.col("grp").asc_nulls_last(), *descending("val")], 50)
    found = ranking.ranked_head_per_group(frame, "grp", "val", 50, "val")
    columns = ["id", "grp", "val", "dense_rank", F.round("group_mean", 9)]
    same(found.select(*columns), direct.select(*columns))


@pytest.mark.parametrize("values", [1, 3, 25, 10_000])
@pytest.mark.parametrize("size", [0, 1, 2, 400])
def test_percent_rank_head(spark, size, values):
    frame = data(spark, size, values=values).filter("val IS NOT NULL")
    direct = frame.withColumn("share", F.percent_rank().over(Window.orderBy("val")))
    same(ranking.percent_rank_head(frame, "val", 30, "share"), top_n(direct, descending("val"), 30))


def test_top_n_per_group_prunes_before_the_shuffle(spark):
    frame = top_n_per_group(data(spark), "grp", descending("val"), 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert frame.groupBy("grp").count().filter("count > 2").count() == 0


def test_no_full_sort_in_one_task(spark):
    """Windows without partitions run only on rows already cut to a few."""
    frame = data(spark)
    for result in (
        ranking.ranked_head(frame, "val", 25),
        ranking.next_in_group(frame, "grp", descending("val"), "val", 40, "next"),
        ranking.previous_in_group(frame, "grp", ascending("val"), "val", 40, "prev"),
    ):
        plan = result._jdf.queryExecution().executedPlan().toString()
        below_window = plan[plan.rindex("Window [") :]
        assert "TakeOrderedAndProject" in below_window
    # The percentile's list was fetched: its window runs on these rows alone.
    plan = ranking.percent_rank_head(frame, "val", 30, "share")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan[plan.rindex("Window [") :] and plan.count("Scan") == 1
