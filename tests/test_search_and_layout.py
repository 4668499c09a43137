"""Trigram search, exact most frequent values, and the clustered layout."""

import random
import time
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalens.operators import heavy, trigrams
from catalens.plans.catalogue import containing
from catalens.sources import clustered

WORDS = ["war", "Wärme", "peace", "star wars", "A.I.", "robot", "the", "İstanbul", "水の中", "%_x", "ab"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(6)

    def text():
        return rnd.choice([None, "", "wa", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 9)))])

    return spark.createDataFrame([(i, text(), text()) for i in range(1500)], "id long, title string, overview string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    return trigrams.build(texts, ("title", "overview"), f"{tmp_path_factory.mktemp('grams')}/index", part_rows=20)


@pytest.mark.parametrize("phrase", ["WAR", "star wars", "wär", "ärme p", "水の", "の", "%_x", "a.i. the", "", "wa", "nowhere", "İstanbul", "peace war robot the"])
def test_searches_equal_a_scan(texts, index, phrase):
    for column in ("title", "overview"):
        found = containing(index.candidates(column, phrase), column, phrase)
        assert found.columns == texts.columns
        assert Counter(found.collect()) == Counter(containing(texts, column, phrase).collect())


def test_searches_read_few_rows(texts, index):
    phrase = "a.i. robot peace"
    hits = containing(texts, "title", phrase).count()
    candidates = index.candidates("title", phrase)
    assert 0 < hits <= candidates.count() < 10 * hits < 1500 / 4
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_block" in plan or "_block#" in plan.split("PartitionFilters")[1]
    assert index.candidates("title", "qqq").count() == 0
    lists = index.spark.read.parquet(f"{index.folder}/postings")
    assert lists.agg(F.max("n")).first()[0] <= 60  # a common trigram's list is cut by part


def test_no_task_writes_many_parts_or_lists(spark, tmp_path):
    rows = spark.range(6400).select("id", F.concat(F.lit("the war "), F.col("id").cast("string")).alias("title"))
    index = trigrams.build(rows, ("title",), f"{tmp_path}/many", part_rows=100)  # 64 parts, one block
    tasks = index.rows.groupBy(F.input_file_name()).count().collect()
    assert len(tasks) > 20 and max(r["count"] for r in tasks) < 6400 / 6
    lists = spark.read.parquet(f"{index.folder}/postings").groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    assert len(lists) > 8 and max(r["n"] for r in lists) < sum(r["n"] for r in lists) / 3
    assert containing(index.candidates("title", "war 63"), "title", "war 63").count() == 111


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def test_an_index_leaves_its_lists_and_rows_only(spark, tmp_path):
    """What was shuffled and the rows as they came are gone."""
    rows = spark.range(4000).repartition(5).select("id", F.concat(F.lit("star wars "), F.sha1(F.col("id").cast("string"))).alias("title"))
    before = shuffle_files(spark)
    index = trigrams.build(rows, ("title",), f"{tmp_path}/once", part_rows=500)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert {p.name for p in Path(f"{tmp_path}/once").iterdir()} == {"rows", "postings"}
    assert containing(index.candidates("title", "wars 0a"), "title", "wars 0a").count() == containing(rows, "title", "wars 0a").count() > 0


def test_lists_of_long_texts_come_in_pieces(spark, tmp_path, monkeypatch):
    """Texts of one part beyond what is made at once: a search puts the pieces together."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.md5(F.concat_ws("-", "key", i))), " ")
    rows = spark.range(60).withColumn("key", F.col("id") % 55).select("id", words.alias("title"))
    rows = rows.unionByName(rows.where("id < 3"))  # ids may repeat
    index = trigrams.build(rows, ("title",), f"{tmp_path}/long")
    lists = spark.read.parquet(f"{index.folder}/postings")
    assert lists.groupBy("gram", "part").count().agg(F.max("count")).first()[0] >= 2
    monkeypatch.setattr(trigrams, "TEXT_A_FILE", 2 << 20)
    index = trigrams.build(rows, ("title",), f"{tmp_path}/longer")
    assert spark.read.parquet(f"{index.folder}/postings").select(F.input_file_name()).distinct().count() >= 4  # by several tasks
    phrase = rows.where("id = 58").first()["title"][70:90]  # also in row 3
    found = containing(index.candidates("title", phrase), "title", phrase)
    assert sorted(r["id"] for r in found.select("id").collect()) == [3, 58]
    assert sorted(r["id"] for r in index.candidates("title", "0 1").select("id").collect()) == sorted([*range(60), 0, 1, 2])


def test_an_index_of_nothing(spark, texts, tmp_path):
    none = trigrams.build(texts.limit(0), ("title",), f"{tmp_path}/none")
    assert none.candidates("title", "war").count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(8)
    values = ["top"] * 900 + [None] * 500 + ["second"] * 400 + ["x", "y"] * 120 + [f"rare {rnd.randrange(4000)}" for _ in range(3000)]
    rnd.shuffle(values)
    return spark.createDataFrame([(v,) for v in values], "value string").repartition(6)


@pytest.mark.parametrize("tracked, recounted", [(4096, 16384), (60, 100), (20, 8), (3, 4), (4096, 3)])
def test_most_frequent_values_are_exact(skewed, tracked, recounted):
    for n in (1, 3, 5, 40):
        expected = heavy._counted(skewed, "value", n, "movie_count").collect()
        assert heavy.top_counts(skewed, "value", n, tracked=tracked, recounted=recounted).collect() == expected


def test_proven_lists_are_not_counted_whole(skewed, monkeypatch):
    monkeypatch.setattr(heavy, "_counted", None)
    assert [r[0] for r in heavy.top_counts(skewed, "value", 3, tracked=60).collect()] == ["top", None, "second"]
    with pytest.raises(TypeError):  # the fourth value's rows cannot be told from rare ones'
        heavy.top_counts(skewed, "value", 5, tracked=3, recounted=4)


def test_summaries_bound_every_count():
    rnd = random.Random(1)
    values = [f"v{min(rnd.randrange(400), rnd.randrange(400))}" for _ in range(5000)]
    held, error = Counter(), 0
    for value in values:
        held[value] += 1
        if len(held) > 80:
            error += heavy.reduce_counts(held, 40)
    exact = Counter(values)
    assert len(held) <= 80 and all(held[v] <= exact[v] <= held[v] + error for v in exact)


def test_most_frequent_of_nothing(skewed):
    assert heavy.top_counts(skewed.limit(0), "value", 3).count() == 0


def test_the_layout_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).selectExpr("id", "cast(id % 90 as int) release_year", "id % 7 vote_count", "'en' original_language")
    rows = rows.mapInArrow(count, rows.schema)
    clustered.write_clustered(rows, f"{tmp_path}/once", files=4)
    assert made.value == 3000 and spark.read.parquet(f"{tmp_path}/once").count() == 3000


def test_a_narrow_slice_skips_most_files(spark, tmp_path):
    rnd = random.Random(2)
    rows = spark.createDataFrame(
        [(i, rnd.choice([None, *range(1950, 2020)]), rnd.randrange(3000), rnd.choice(["en", "fr", "de", "日本", None])) for i in range(20_000)],
        "id long, release_year int, vote_count long, original_language string",
    )
    rows.repartition(64).write.parquet(f"{tmp_path}/plain")
    clustered.write_clustered(rows, f"{tmp_path}/clustered", files=64)
    assert Counter(spark.read.parquet(f"{tmp_path}/clustered").collect()) == Counter(rows.collect())

    def read(folder):
        """Row groups that may hold a row of the slice."""
        kept = groups = 0
        for file in Path(folder).glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                year, votes = stats["release_year"], stats["vote_count"]
                groups += 1
                kept += bool(year.has_min_max) and year.min <= 1993 and year.max >= 1990 and votes.max >= 2500
        return kept / groups

    assert read(f"{tmp_path}/plain") == 1.0 and read(f"{tmp_path}/clustered") < 0.2
    clustered.write_clustered(rows.limit(0), f"{tmp_path}/none")
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/none").count() == 0
