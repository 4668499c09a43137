"""The two quality gates."""

import pytest

from catalens.operators import quality
from catalens.params import QualityRules
from dataclasses import replace


def by_name(report):
    return {r.name: (r.passed, r.detail) for r in report.collect()}


def test_good_frame_passes(four, low_gates):
    report = quality.check_clean(four, low_gates)
    assert by_name(report) == {
        "min_clean_rows": (True, "4 rows (floor 1)"),
        "no_null_id": (True, "0 nulls"),
        "no_null_title": (True, "0 nulls"),
        "no_null_release_date": (True, "0 nulls"),
        "rating_in_range": (True, "min=5.5 max=8.2"),
        "runtime_non_negative": (True, "min=88"),
        "unique_id": (True, "0 duplicate ids"),
    }
    assert quality.failures(report).count() == 0
    (total,) = quality.verdict(report).collect()
    assert (total.ok, total.failing) == (True, 0)
    assert total.summary.splitlines()[:3] == [
        "[PASS] clean (0 failing)", "  ok  min_clean_rows: 4 rows (floor 1)",
        "  ok  no_null_id: 0 nulls",
    ]


@pytest.mark.parametrize(
    ("index", "change", "failing"),
    [
        (0, {"title": None}, "no_null_title"),
        (0, {"vote_average": 99.0}, "rating_in_range"),
        (1, {"id": 1}, "unique_id"),
        (2, {"runtime": -1.0}, "runtime_non_negative"),
        (3, {"release_date": None}, "no_null_release_date"),
    ],
)
def test_broken_frames_fail(clean_frame, four_rows, low_gates, index, change, failing):
    four_rows[index].update(change)
    report = quality.check_clean(clean_frame(*four_rows), low_gates)
    assert [r.name for r in quality.failures(report).collect()] == [failing]
    with pytest.raises(quality.ValidationError, match=failing):
        quality.enforce(report, replace(low_gates, hard_fail=True))
    assert quality.enforce(report, low_gates) is report


def test_null_ids_repeat_each_other(clean_frame, low_gates):
    frame = clean_frame({"id": None}, {"id": None}, {"id": None}, {"id": 5}, {"id": 5})
    report = by_name(quality.check_clean(frame, low_gates, only=["unique_id", "no_null_id"]))
    assert report == {"unique_id": (False, "3 duplicate ids"), "no_null_id": (False, "3 nulls")}


def test_missing_columns(clean_frame, low_gates):
    frame = clean_frame({"id": 1}, columns=("id",))
    report = by_name(quality.check_clean(frame, low_gates))
    assert report["no_null_title"] == (False, "-1 nulls")
    assert "rating_in_range" not in report and "runtime_non_negative" not in report


def test_empty_frame(clean_frame, low_gates):
    report = by_name(quality.check_clean(clean_frame(), low_gates))
    assert report["min_clean_rows"] == (False, "0 rows (floor 1)")
    assert report["rating_in_range"] == (True, "no data")
    assert report["runtime_non_negative"] == (True, "no data")
    assert report["unique_id"] == (True, "0 duplicate ids")


def test_raw_gate(raw_frame, low_gates):
    raw = raw_frame({"id": 1}, {"id": 2})
    assert by_name(quality.check_raw(raw, low_gates)) == {
        "required_columns": (True, "all present"),
        "min_raw_rows": (True, "2 rows (floor 1)"),
    }
    assert by_name(quality.check_raw(raw, QualityRules()))["min_raw_rows"] == (
        False, "2 rows (floor 100,000)",
    )
    short = by_name(quality.check_raw(raw.drop("budget", "title"), low_gates, only=["required_columns"]))
    assert short == {"required_columns": (False, "missing: ['title', 'budget']")}


def test_one_scan_for_all_checks(four, low_gates):
    plan = quality.check_clean(four, low_gates)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


@pytest.mark.parametrize("spread", [1, 3, 10**9])
def test_unique_ids_by_bitmaps(spark, spread):
    numbers = [None, None, -70_000, -1, 0, 0, 32_767, 32_768, 32_769, *[spread * (i % 900) for i in range(2000)], 2**62 if spread > 3 else 7]
    frame = spark.createDataFrame([(n,) for n in numbers], "id long").repartition(5)
    found = quality.distinct_whole_numbers(frame, "id").first()
    assert (found["rows"], found["distinct"]) == (len(numbers), len(set(numbers)))
    assert quality.check_unique(frame).collect() == quality.check_clean(frame, only=["unique_id"]).collect()
    plan = quality.distinct_whole_numbers(frame, "id")._jdf.queryExecution().executedPlan().toString()
    assert ("bitmap" in plan) == (spread == 1 or spread == 3)
    assert quality.distinct_whole_numbers(frame.limit(0), "id").first()["distinct"] == 0
    assert quality.check_unique(frame.where("id IS NULL")).first()["detail"] == "1 duplicate ids"
