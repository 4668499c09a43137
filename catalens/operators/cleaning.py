"""Raw text rows to typed, gated, deduplicated and enriched rows.

The steps run in this order: typed -> admissible -> best_copy -> enriched.
The gate comes before the deduplication on purpose: when the most-voted copy of
an id is junk, a valid copy with fewer votes must survive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from catalens.functions import parse, rules
from catalens.params import CleanRules
from catalens.schema import CLEAN_COLUMNS
from catalens.sources.files import write_clean
from catalens.sources.split_csv import MALFORMED

UNKNOWN = "Unknown"

_TYPED = {
    "id": parse.parse_long,
    "title": parse.trim_spaces,
    "original_title": parse.trim_spaces,
    "status": parse.blank_to_null,
    "release_date": parse.parse_date,
    "revenue": parse.parse_double,
    "budget": parse.parse_double,
    "runtime": parse.parse_double,
    "vote_average": parse.parse_double,
    "vote_count": parse.parse_long,
    "popularity": parse.parse_double,
    "adult": parse.parse_flag,
    "original_language": parse.blank_to_null,
    "genres": parse.blank_to_null,
    "production_countries": parse.blank_to_null,
    "spoken_languages": parse.blank_to_null,
    "keywords": parse.blank_to_null,
    "overview": lambda text: text,
}


def parsed(column: str) -> Column:
    """The text column of this name, read into its clean type."""
    return _TYPED[column](F.col(column)).alias(column)


def typed(raw: DataFrame, *columns: str) -> DataFrame:
    """Parse the given text columns (all by default) into their clean types.

    The parsed row is one struct that `inline` unpacks again. Filters are not
    pushed through it, so every text is parsed once. Without it the optimizer
    copies the parsing of a column into each predicate that uses it, and the
    generated filter grows beyond what the JVM compiles (2.5 times slower).
    """
    return raw.select(F.inline(F.array(F.struct(*[parsed(c) for c in columns or _TYPED]))))


# --- the gate, one predicate per rule ------------------------------------


def has_required() -> Column:
    return (
        F.col("id").isNotNull()
        & F.col("title").isNotNull()
        & (F.col("title") != "")
        & F.col("release_date").isNotNull()
    )


def title_long_enough(limits: CleanRules) -> Column:
    """Very short titles need votes; unknown votes do not count as enough."""
    return (F.length("title") >= limits.min_title_length) | (
        F.col("vote_count") >= limits.short_title_min_votes
    )


def title_not_junk(limits: CleanRules) -> Column:
    return ~rules.matches_any(F.col("title"), limits.junk_patterns)


def year_in_range(limits: CleanRules) -> Column:
    return F.year("release_date").between(limits.min_year, limits.max_year)


def measures_in_range(limits: CleanRules) -> Column:
    """Unknown measures pass, impossible ones do not."""
    return (
        rules.null_or_between(F.col("revenue"), 0, limits.max_revenue)
        & rules.null_or_between(F.col("budget"), 0, limits.max_budget)
        & rules.null_or_between(F.col("runtime"), 0, limits.max_runtime)
    )


def rating_in_range(limits: CleanRules) -> Column:
    return rules.null_or_between(F.col("vote_average"), limits.min_rating, limits.max_rating)


def admissible(rows: DataFrame, limits: CleanRules, not_junk: Column | None = None) -> DataFrame:
    """`not_junk`: what `title_not_junk` says, where that is known already."""
    return rows.filter(
        has_required()
        & title_long_enough(limits)
        & (title_not_junk(limits) if not_junk is None else not_junk)
        & year_in_range(limits)
        & measures_in_range(limits)
        & rating_in_range(limits)
    )


# --- one row per id -------------------------------------------------------


def best_copy(rows: DataFrame, *within: str) -> DataFrame:
    """Keep the copy with the most votes of each id.

    `within` names columns that follow from the id; rows partitioned by these are not
    shuffled again.

    The remaining columns break ties, so the survivor does not depend on the
    order of arrival. The filter on the row number lets Spark prune copies in
    every task before the shuffle, so an id with very many copies sends only
    one row per task.
    """
    first = ["title", "original_title", "release_date"]
    rest = [c for c in rows.columns if c not in {"id", "vote_count", *first, *within}]
    order = [F.col("vote_count").desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in first + rest if c in rows.columns]
    return (
        rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*within, "id").orderBy(*order)))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


# --- derived columns ------------------------------------------------------


def with_date_parts(rows: DataFrame) -> DataFrame:
    year = F.year("release_date")
    return rows.withColumns({
        "release_year": year,
        "release_decade": rules.decade(year),
        "release_month": F.month("release_date"),
    })


def with_labels(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "original_language": F.coalesce("original_language", F.lit(UNKNOWN)),
        "production_countries": F.coalesce("production_countries", F.lit(UNKNOWN)),
        "primary_genre": rules.first_token(F.col("genres")),
    })


def with_financials(rows: DataFrame) -> DataFrame:
    revenue, budget = F.col("revenue"), F.col("budget")
    return rows.withColumns({
        "profit": rules.profit(revenue, budget),
        "roi": rules.return_on_budget(revenue, budget),
        "profit_pct": rules.profit_percent(revenue, budget),
        "has_financials": rules.both_known(revenue, budget),
    })


def enriched(rows: DataFrame, *more: str) -> DataFrame:
    """The clean columns, and `more` of the given ones."""
    return (
        rows.transform(with_date_parts)
        .transform(with_labels)
        .transform(with_financials)
        .select(*CLEAN_COLUMNS, *more)
    )


def clean(raw: DataFrame, limits: CleanRules = CleanRules()) -> DataFrame:
    """The whole chain: text rows in, the 26-column clean table out."""
    return (
        raw.transform(typed)
        .transform(admissible, limits)
        .transform(best_copy)
        .transform(enriched)
    )


# --- what cleaning removed ------------------------------------------------


def _counts(limits: CleanRules, missing: Column, bad_date: Column, junk: Column, revenue: Column, good: Column) -> list[Column]:
    """Overlapping counts over the good raw rows."""
    return [
        F.count_if(good).alias("raw_rows"),
        F.count_if(good & missing).alias("missing_title"),
        F.count_if(good & bad_date).alias("bad_date"),
        F.count_if(good & junk).alias("spam_title"),
        F.count_if(good & (revenue > limits.max_revenue)).alias("over_cap_revenue"),
    ]


def diagnostics(raw: DataFrame, limits: CleanRules = CleanRules()) -> DataFrame:
    """One row of overlapping counts over the raw rows, in a single pass."""
    title = F.col("title")
    missing = title.isNull() | (parse.trim_spaces(title) == "")
    bad_date = parse.parse_date(F.col("release_date")).isNull()
    junk = rules.matches_any(title, limits.junk_patterns)
    return raw.agg(*_counts(limits, missing, bad_date, junk, parse.parse_double(F.col("revenue")), F.lit(True)))


class Observed:
    """Cleaning that counts on the way, so the raw rows are read and parsed once.

    `cleaned` is the clean table as a plan. `summary_of` makes a summary row of the counts.
    The raw frame may have the column `_malformed` of `read_raw_csv`.
    """

    def __init__(self, raw: DataFrame, limits: CleanRules = CleanRules()):
        self._spark, self._raw, self._limits = raw.sparkSession, raw, limits
        self._raw_counts, self._clean_count = Observation(), Observation()
        self._tag = f"cleaning-{uuid.uuid4().hex}"
        malformed = F.col(MALFORMED) if MALFORMED in raw.columns else F.lit(None).cast("string")
        # As in `typed`; the patterns are sought in the title as written, and once more only where trimming changed it.
        junk = rules.matches_any(F.col("title"), limits.junk_patterns)
        extra = [F.col("title").alias("_title"), junk.alias("_junk"), malformed.isNull().alias("_good")]
        rows = raw.select(F.inline(F.array(F.struct(*[parsed(c) for c in _TYPED], *extra))))
        title = F.col("title")
        counts = _counts(
            limits, title.isNull() | (title == ""), F.col("release_date").isNull(), F.col("_junk"), F.col("revenue"), F.col("_good")
        )
        rows = rows.observe(self._raw_counts, *counts, F.count_if(~F.col("_good")).alias("malformed_rows"))
        not_junk = F.when(title == F.col("_title"), ~F.col("_junk")).otherwise(title_not_junk(limits))
        rows = rows.where("_good").transform(admissible, limits, not_junk).drop("_title", "_junk", "_good")
        whole = rows.transform(best_copy).transform(enriched)
        self.cleaned = whole.observe(self._clean_count, F.count("*").alias("clean_rows"))

    def write(self, path: str) -> bool:
        """Write the clean table. False if a stage ran twice, for example after an executor
        was lost: its rows are then counted twice, and the counts must be taken anew."""
        context = self._spark.sparkContext
        group = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(self._tag, "cleaning")
        try:
            write_clean(self.cleaned, path)
        finally:
            context.setLocalProperty("spark.jobGroup.id", group)
        return ran_once(self._spark, self._tag)

    def counts(self) -> dict[str, int]:
        """After `write`."""
        return {**self._raw_counts.get, **self._clean_count.get}

    def recount(self, path: str) -> dict[str, int]:
        """The same counts by a second pass over the raw rows and the table at `path`."""
        good = F.col(MALFORMED).isNull() if MALFORMED in self._raw.columns else F.lit(True)
        counts = diagnostics(self._raw.where(good), self._limits).first().asDict()
        counts["malformed_rows"] = self._raw.where(~good).count()
        counts["clean_rows"] = self._spark.read.parquet(path).count()
        return counts


def ran_once(spark: SparkSession, group: str) -> bool:
    """Whether every stage of a job group ran in one attempt."""
    tracker = spark.sparkContext.statusTracker()
    jobs = filter(None, map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)))
    stages = filter(None, (tracker.getStageInfo(s) for job in jobs for s in job.stageIds))
    return all(stage.currentAttemptId == 0 for stage in stages)


def summary_of(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """The row of `cleaning_summary` from counts that are known, with the malformed rows."""
    found = [F.lit(counts[c]).cast("bigint").alias(c) for c in ("raw_rows", "missing_title", "bad_date", "spam_title", "over_cap_revenue")]
    cleaned = spark.range(1).select(F.lit(counts["clean_rows"]).cast("bigint").alias("clean_rows"))
    row = _summary(spark.range(1).select(*found).join(cleaned))
    return row.withColumn("malformed_rows", F.lit(counts["malformed_rows"]).cast("bigint"))


def cleaning_summary(found: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows in, rows out and the reasons, as one row.

    `found` is the row of `diagnostics`, `cleaned` the clean table.
    """
    return _summary(found.withColumn("clean_rows", cleaned.agg(F.count("*")).scalar()))


def _summary(found: DataFrame) -> DataFrame:
    raw_rows, clean_rows = F.col("raw_rows"), F.col("clean_rows")
    kept = F.round(F.lit(100.0) * clean_rows / raw_rows, 2)
    return found.select(
        raw_rows,
        clean_rows,
        (raw_rows - clean_rows).alias("dropped_rows"),
        F.when(raw_rows > 0, kept).otherwise(0.0).alias("pct_kept"),
        "missing_title",
        F.col("bad_date").alias("bad_or_missing_date"),
        F.col("spam_title").alias("spam_titles"),
        "over_cap_revenue",
    )
