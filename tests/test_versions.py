"""Manifests of clean tables, deliveries into buckets, and counts observed while cleaning."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalens.operators import cleaning
from catalens.params import CleanRules
from catalens.plans.batch import clean_or_reuse
from catalens.schema import CLEAN_COLUMNS, text_schema
from catalens.sources import files, versions
from tests.test_cleaning import MESSY, row


def rows(frame):
    return Counter(map(tuple, frame.collect()))


@pytest.fixture
def delivered(raw_frame):
    """Rows with many copies per id; equal votes leave the choice to the other columns."""
    rnd = random.Random(4)
    return [
        row(
            id=rnd.randint(1, 40), title=rnd.choice(["One", "Two", "unsubscribe now"]), vote_count=rnd.choice([None, "1", "2"]),
            original_language=rnd.choice([None, "Unknown", "en"]), production_countries=rnd.choice([None, "Unknown", "U"]),
            genres=rnd.choice(["Drama", None]), revenue=rnd.choice(["0", "5", "99999999999"]),
        )
        for _ in range(300)
    ]


def test_deliveries_equal_one_cleaning(spark, raw_frame, delivered, tmp_path):
    table = versions.BucketTable(spark, f"{tmp_path}/table", buckets=8)
    assert table.newest() is None
    for part in range(3):
        table.merge(raw_frame(*delivered[part * 100 : part * 100 + 100]))
    expected = rows(cleaning.clean(raw_frame(*delivered)))
    assert rows(table.read()) == expected and table.read().columns == list(CLEAN_COLUMNS)
    assert rows(table.read(1)) == rows(cleaning.clean(raw_frame(*delivered[:100])))
    assert table.newest().number == 3


def test_untouched_buckets_keep_their_files(spark, raw_frame, delivered, tmp_path):
    table = versions.BucketTable(spark, f"{tmp_path}/table", buckets=8)
    first = table.merge(raw_frame(*delivered))
    second = table.merge(raw_frame(row(id=3, title="Better", vote_count="500")), digest="d2")
    changed = {b for b in first.folders if first.folders[b] != second.folders[b]}
    assert len(changed) == 1 and set(second.folders) == set(first.folders) == set(range(8))
    assert table.read().where("id = 3").first().title == "Better"
    assert all((tmp_path / "table" / f).is_dir() for f in [*first.folders.values(), *second.folders.values()])
    assert table.merge(raw_frame(row(id=4, title="Again")), digest="d2") == second  # taken already
    third = table.merge(raw_frame(row(id=5, title="unsubscribe")))  # nothing admissible
    assert third.folders == second.folders and third.number == 3
    table.vacuum(keep=1)
    assert rows(table.read()) == rows(cleaning.clean(raw_frame(*delivered, row(id=3, title="Better", vote_count="500"))))
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_a_broken_merge_leaves_the_old_version(spark, raw_frame, delivered, tmp_path, monkeypatch):
    table = versions.BucketTable(spark, f"{tmp_path}/table", buckets=4)
    table.merge(raw_frame(*delivered[:150]))
    before = rows(table.read())

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(versions, "write_manifest", broken)
        table.merge(raw_frame(*delivered[150:]))
    assert table.newest().number == 1 and rows(table.read()) == before
    table.merge(raw_frame(*delivered[150:]))
    assert rows(table.read()) == rows(cleaning.clean(raw_frame(*delivered)))


def test_two_runs_cannot_make_one_version(spark, tmp_path):
    versions.write_manifest(spark, f"{tmp_path}/m.json", {"a": 1})
    with pytest.raises(FileExistsError):
        versions.write_manifest(spark, f"{tmp_path}/m.json", {"a": 2})
    assert versions.read_manifest(spark, f"{tmp_path}/m.json") == {"a": 1}
    assert not list(tmp_path.glob("m.json.*"))


def test_merging_shuffles_the_rows_once(spark, raw_frame, delivered):
    """Rows that were dealt by bucket are not dealt again for the choice of copies."""
    typed = cleaning.typed(raw_frame(*delivered)).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    best = cleaning.best_copy(typed.repartition(8, "_bucket"), "_bucket")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_digests_follow_files_and_rules(spark, tmp_path):
    def digest(*rules):
        return versions.input_digest(spark, f"{tmp_path}/raw", *rules)

    (tmp_path / "raw").mkdir()
    one = tmp_path / "raw" / "a.csv"
    one.write_text("x")
    first = digest(CleanRules())
    assert digest(CleanRules()) == first
    assert digest(CleanRules(max_year=2000)) != first
    one.write_text("xy")
    longer = digest(CleanRules())
    (tmp_path / "raw" / "b.csv").write_text("x")
    assert len({first, longer, digest(CleanRules())}) == 3


def test_reuse_asks_for_the_same_inputs_and_rules(spark, raw_frame, tmp_path):
    raw, path = raw_frame(*MESSY), f"{tmp_path}/clean"

    def run(digest, reuse=True, gate=lambda counts: None):
        return clean_or_reuse(spark, lambda: raw, path, digest, reuse=reuse, gate=gate)

    def reused(made):
        return "note" in made.summary.columns

    assert [reused(run("a")), reused(run("a")), reused(run("b")), reused(run("a")), reused(run("a", reuse=False))] == [
        False, True, False, False, False,
    ]
    before = sorted(p.name for p in Path(path).glob("*.parquet"))

    def refuse(counts):
        assert counts["raw_rows"] == 5 and counts["clean_rows"] == 1
        raise ValueError("refused")

    for digest in ("a", "c"):  # the gate sees the counts of a reused table, too
        with pytest.raises(ValueError, match="refused"):
            run(digest, gate=refuse)
    assert sorted(p.name for p in Path(path).glob("*.parquet")) == before and reused(run("a"))
    assert not list(tmp_path.glob("clean.*[!t]")) or [p.name for p in tmp_path.glob("clean.*")] == ["clean.manifest"]


def test_observed_counts_equal_a_pass_of_their_own(spark, raw_frame, delivered, tmp_path):
    files.write_raw_csv(raw_frame(*delivered, *MESSY, row(id=77, title="  unsubscribe  ", release_date="bad")), f"{tmp_path}/raw")
    spark.createDataFrame([(",".join(text_schema().names) + "\n1,short",)], "t string").coalesce(1).write.mode("append").text(f"{tmp_path}/raw")
    raw = files.read_raw_csv(spark, f"{tmp_path}/raw", keep_malformed=True)
    observed = cleaning.Observed(raw)
    assert observed.write(f"{tmp_path}/clean")
    counts = observed.counts()
    assert counts == observed.recount(f"{tmp_path}/clean") and counts["malformed_rows"] == 1 and counts["raw_rows"] == 306
    good = files.read_raw_csv(spark, f"{tmp_path}/raw")
    assert rows(files.read_clean(spark, f"{tmp_path}/clean", None)) == rows(cleaning.clean(good))
    summary = cleaning.summary_of(spark, counts)
    expected = cleaning.cleaning_summary(cleaning.diagnostics(good), cleaning.clean(good)).withColumn("malformed_rows", F.lit(1).cast("bigint"))
    assert summary.first() == expected.first() and summary.columns == expected.columns
    empty = cleaning.Observed(raw_frame())
    assert empty.write(f"{tmp_path}/none") and set(empty.counts().values()) == {0}
    assert cleaning.summary_of(spark, empty.counts()).first().pct_kept == 0.0


def test_stages_that_ran_twice_are_noticed(spark, monkeypatch):
    from pyspark.status import SparkStageInfo, StatusTracker

    monkeypatch.setattr(StatusTracker, "getJobIdsForGroup", lambda self, group: [0])
    monkeypatch.setattr(StatusTracker, "getJobInfo", lambda self, job: type("Job", (), {"stageIds": [0, 1]}))
    for attempts, once in (((0, 0), True), ((0, 1), False)):
        monkeypatch.setattr(
            StatusTracker, "getStageInfo", lambda self, s: SparkStageInfo(s, attempts[s], "n", 1, 0, 1, 0)
        )
        assert cleaning.ran_once(spark, "g") is once


@pytest.mark.parametrize("name", ["reuse_clean", "clean_merge"])
def test_the_raw_rows_are_made_once(spark, monkeypatch, name):
    """The runs and deliveries of a query start from the same written rows."""
    from catalens.bindings import queries as bound

    calls, own = [], files.materialise
    monkeypatch.setattr(bound, "raw_catalog", lambda spark, sf_dir: calls.append(sf_dir) or raw)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    source = own(_raw_rows(spark), files.shared_folder(spark))
    raw = source.mapInArrow(count, source.schema)
    assert bound.FILES[name](spark, "unused").count() > 0
    assert len(calls) == 1 and made.value == source.count()


def _raw_rows(spark):
    from catalens.bindings.tables import raw_catalog

    return raw_catalog(spark, "/root/testdata/sf0.001")


def test_a_table_written_anew_has_the_same_rows_in_new_files(spark, tmp_path):
    path = f"{tmp_path}/table"
    first = files.materialise(spark.range(50).repartition(3), path)
    before, digest = rows(first), versions.input_digest(spark, path)
    assert rows(files.write_anew(spark, path)) == before
    assert versions.input_digest(spark, path) != digest


def test_titles_are_searched_for_junk_once_and_again_where_trimmed(spark, raw_frame):
    """A pattern may see the blanks around a title: the count takes it as written, the gate trimmed."""
    limits = CleanRules(junk_patterns=(r"\bads$", r"^ x", r"www\.", "BUY now"))
    titles = ["good ads", "ads ", " x ray", "WWW.a", "wwwxa", "buy NOW", "fine", " buy now ", "Ads", None]
    raw = raw_frame(*[row(id=i, title=t) for i, t in enumerate(titles)])
    observed, path = cleaning.Observed(raw, limits), files.shared_folder(spark)
    assert observed.write(path)
    assert spark.read.parquet(path).select(*CLEAN_COLUMNS).exceptAll(cleaning.clean(raw, limits)).count() == 0
    counts = observed.counts()
    assert counts["clean_rows"] == cleaning.clean(raw, limits).count()
    assert counts["spam_title"] == cleaning.diagnostics(raw, limits).first()["spam_title"] == 6
