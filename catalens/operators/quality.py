"""Quality gates: (gate, name, passed, detail) rows for raw and clean frames.

All requested checks of a gate share one aggregate over the data. Its single
row is then spread into one row per check.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.params import QualityRules


class ValidationError(Exception):
    """A gate failed and the rules ask for a hard failure."""


# Names of all checks, in the order a summary lists them.
CHECK_NAMES = (
    "required_columns", "min_raw_rows", "min_clean_rows", "no_null_id", "no_null_title",
    "no_null_release_date", "rating_in_range", "runtime_non_negative", "unique_id",
)


class Check(NamedTuple):
    name: str
    measures: dict[str, Column]  # aggregates, by a name unique to the check
    passed: Column  # over the measures
    detail: Column  # over the measures


def _row_floor(name: str, floor: int, counted: str | None = None) -> Check:
    n = F.col(name)
    return Check(
        name,
        {name: F.sum(counted) if counted else F.count("*")},
        n >= floor,
        F.concat(F.format_number(n, 0), F.lit(f" rows (floor {floor:,})")),
    )


def _no_nulls(column: str, present: bool) -> Check:
    name = f"no_null_{column}"
    nulls = F.count_if(F.col(column).isNull()) if present else F.lit(-1).cast("bigint")
    return Check(name, {name: nulls}, F.col(name) == 0, F.format_string("%d nulls", F.col(name)))


def _rating_in_range(limits: QualityRules) -> Check:
    value = F.col("vote_average")
    outside = F.count_if(~value.between(limits.min_rating, limits.max_rating))
    measures = {"rating_min": F.min(value), "rating_max": F.max(value), "rating_outside": outside}
    detail = F.when(F.col("rating_min").isNull(), "no data").otherwise(
        F.format_string("min=%.1f max=%.1f", F.col("rating_min"), F.col("rating_max"))
    )
    return Check("rating_in_range", measures, F.col("rating_outside") == 0, detail)


def _runtime_non_negative() -> Check:
    low = F.col("runtime_min")
    return Check(
        "runtime_non_negative",
        {"runtime_min": F.min("runtime")},
        low.isNull() | (low >= 0),
        F.when(low.isNull(), "no data").otherwise(F.format_string("min=%.0f", low)),
    )


def _unique_id() -> Check:
    """Counts the extra rows of repeated ids; NULL ids repeat each other."""
    identifier = F.col("id")
    distinct = F.count_distinct(identifier) + F.max(identifier.isNull().cast("int"))
    extra = F.coalesce(F.count("*") - distinct, F.lit(0))
    return Check(
        "unique_id",
        {"unique_id": extra.cast("bigint")},
        F.col("unique_id") == 0,
        F.format_string("%d duplicate ids", F.col("unique_id")),
    )


def clean_checks(columns: Iterable[str], limits: QualityRules) -> list[Check]:
    """Every check of the clean gate that applies to a frame with these columns."""
    present = set(columns)
    checks = [_row_floor("min_clean_rows", limits.min_clean_rows)]
    checks += [_no_nulls(c, c in present) for c in ("id", "title", "release_date")]
    if "vote_average" in present:
        checks.append(_rating_in_range(limits))
    if "runtime" in present:
        checks.append(_runtime_non_negative())
    if "id" in present:
        checks.append(_unique_id())
    return checks


def run_checks(rows: DataFrame, gate: str, checks: list[Check]) -> DataFrame:
    measures = {name: expr for check in checks for name, expr in check.measures.items()}
    if measures:
        measured = rows.agg(*[expr.alias(name) for name, expr in measures.items()])
    else:  # checks on the header alone read no rows
        measured = rows.limit(0).agg(F.count("*").alias("no_rows"))
    results = F.array(*[
        F.struct(
            F.lit(gate).alias("gate"),
            F.lit(check.name).alias("name"),
            check.passed.alias("passed"),
            check.detail.alias("detail"),
        )
        for check in checks
    ])
    return measured.select(F.inline(results))


def check_clean(
    rows: DataFrame, limits: QualityRules = QualityRules(), only: Iterable[str] | None = None
) -> DataFrame:
    """The clean gate; `only` restricts it (and its aggregate) to some checks."""
    checks = clean_checks(rows.columns, limits)
    if only is not None:
        wanted = set(only)
        checks = [c for c in checks if c.name in wanted]
    return run_checks(rows, "clean", checks)


#: Up to so many numbers of the id range per row, a bitmap of the range is smaller than the ids.
DENSE = 64


def distinct_whole_numbers(rows: DataFrame, column: str) -> DataFrame:
    """One row: `rows`, `distinct` (a NULL is one value).

    Numbers that lie close are marked as bits, 32,768 to a bitmap, in every task, and the
    bitmaps of a range are merged: about a bit per number moves instead of the number. Where
    the range is too wide for that, numbers are grouped as they are.
    """
    number = F.col(column).cast("bigint")
    low, high, known, everything = rows.agg(F.min(number), F.max(number), F.count(number), F.count("*")).first()
    present = rows.filter(number.isNotNull())
    if known and high - low < DENSE * known:
        marked = present.groupBy(F.bitmap_bucket_number(number).alias("bucket"))
        bits = marked.agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(number))).alias("numbers"))
        distinct = bits.agg(F.coalesce(F.sum("numbers"), F.lit(0)).alias("distinct"))
    else:
        distinct = present.groupBy(number.alias("number")).agg(F.lit(1)).agg(F.count("*").alias("distinct"))
    nulls = int(everything > known)
    return distinct.select(F.lit(everything).cast("bigint").alias("rows"), (F.col("distinct") + nulls).cast("bigint").alias("distinct"))


def check_unique(rows: DataFrame, column: str = "id") -> DataFrame:
    """The check `unique_id` of the clean gate by `distinct_whole_numbers`."""
    extra = distinct_whole_numbers(rows, column).select((F.col("rows") - F.col("distinct")).alias("unique_id"))
    check = _unique_id()
    return extra.select(
        F.lit("clean").alias("gate"), F.lit(check.name).alias("name"), check.passed.alias("passed"), check.detail.alias("detail")
    )


def _required_columns(columns: Iterable[str], limits: QualityRules) -> Check:
    present = set(columns)
    missing = [c for c in limits.required_columns if c not in present]
    return Check(
        "required_columns",
        {},
        F.lit(not missing),
        F.lit(f"missing: {missing}" if missing else "all present"),
    )


def check_raw(
    rows: DataFrame, limits: QualityRules = QualityRules(), only: Iterable[str] | None = None
) -> DataFrame:
    """The raw gate: required columns by header, row floor by one count."""
    checks = [_required_columns(rows.columns, limits), _row_floor("min_raw_rows", limits.min_raw_rows)]
    if only is not None:
        wanted = set(only)
        checks = [c for c in checks if c.name in wanted]
    return run_checks(rows, "raw", checks)


def run_raw_header(spark: SparkSession, columns: Iterable[str], limits: QualityRules = QualityRules()) -> DataFrame:
    """The part of the raw gate that needs no rows."""
    return run_checks(spark.range(0), "raw", [_required_columns(columns, limits)])


def check_raw_counted(
    columns: Iterable[str], found: DataFrame, limits: QualityRules = QualityRules()
) -> DataFrame:
    """The raw gate over the diagnostics row, which has the row count already."""
    checks = [_required_columns(columns, limits), _row_floor("min_raw_rows", limits.min_raw_rows, "raw_rows")]
    return run_checks(found, "raw", checks)


def failures(report: DataFrame) -> DataFrame:
    return report.filter(~F.col("passed"))


def verdict(report: DataFrame) -> DataFrame:
    """Per gate: did everything pass, how many failed, and a readable summary."""
    mark = F.when(F.col("passed"), "ok  ").otherwise("XX  ")
    line = F.concat(F.lit("  "), mark, F.col("name"), F.lit(": "), F.col("detail"))
    failing = F.count_if(~F.col("passed"))
    position = F.array_position(F.array(*map(F.lit, CHECK_NAMES)), F.col("name"))
    # A gate has a handful of checks, so the list stays tiny.
    in_order = F.sort_array(F.collect_list(F.struct(position.alias("position"), line.alias("line"))))
    lines = F.array_join(in_order["line"], "\n")
    return report.groupBy("gate").agg(
        F.bool_and("passed").alias("ok"),
        failing.alias("failing"),
        F.concat(
            F.when(F.bool_and("passed"), "[PASS] ").otherwise("[FAIL] "),
            F.col("gate"),
            F.lit(" ("),
            failing.cast("string"),
            F.lit(" failing)\n"),
            lines,
        ).alias("summary"),
    )


def enforce(report: DataFrame, limits: QualityRules = QualityRules()) -> DataFrame:
    """Raise on a failed check when the rules ask for it, else pass the report on."""
    if limits.hard_fail:
        failed = failures(report).select("gate", "name").collect()
        if failed:
            gates = sorted({row.gate for row in failed})
            raise ValidationError(f"{', '.join(gates)} gate failed: {[row.name for row in failed]}")
    return report
