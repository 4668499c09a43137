"""The batch run: raw CSV -> clean Parquet -> both gates -> summary tables.

The raw rows are parsed once: what is counted over them is observed on the way to the
clean table. That table is written beside its place and takes it when the raw gate has
passed, with a manifest of what it was made from. All later steps start from it, so a
lost executor never sends the run back to the raw text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.operators import cleaning, quality
from catalens.params import CleanRules, QualityRules, ReportRules
from catalens.plans import summaries
from catalens.schema import RAW_COLUMNS
from catalens.sources import files, versions


class BatchResult(NamedTuple):
    """The frames are read back from what was written, except a skipped summary."""

    cleaned: DataFrame
    summary: DataFrame
    report: DataFrame
    kpis: DataFrame
    table_paths: dict[str, str]


class Cleaning(NamedTuple):
    cleaned: DataFrame
    summary: DataFrame
    counts: dict[str, int]  # those of `cleaning.Observed`, of the run that wrote the table


def _skipped_summary(spark: SparkSession) -> DataFrame:
    counts = [F.lit(0).cast("bigint").alias(c) for c in ("raw_rows", "clean_rows", "dropped_rows")]
    note = F.lit("clean skipped").alias("note")
    return spark.range(1).select(*counts, F.lit(0.0).alias("pct_kept"), note)


def clean_or_reuse(
    spark: SparkSession,
    raw: Callable[[], DataFrame],
    path: str,
    digest: str,
    limits: CleanRules = CleanRules(),
    reuse: bool = False,
    gate: Callable[[dict[str, int]], object] = lambda counts: None,
) -> Cleaning:
    """The clean table at `path`, its summary row and counts (see `BatchResult`).

    When `reuse` asks for it, a finished table is taken as it is if it was made from the
    inputs and rules that `digest` stands for (see `versions.input_digest`), with zeros and
    a note for a summary; otherwise it is written from what `raw` reads. `gate` gets the counts and
    may raise; a table that was just written is dropped then, and the old one stays.
    """
    if reuse and (found := versions.read_clean_made_from(spark, path, digest)):
        cleaned, counts = found
        gate(counts)
        return Cleaning(cleaned, _skipped_summary(spark), counts)
    staged = f"{path}.{uuid.uuid4().hex}"
    observed = cleaning.Observed(raw(), limits)
    try:
        counts = observed.counts() if observed.write(staged) else observed.recount(staged)
        gate(counts)
        versions.publish_clean(spark, staged, path, digest, counts)
    except Exception:
        files.remove(spark, staged)
        raise
    return Cleaning(files.read_clean(spark, path, columns=None), cleaning.summary_of(spark, counts), counts)


def run_batch(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    limits: CleanRules = CleanRules(),
    gates: QualityRules = QualityRules(),
    reports: ReportRules = ReportRules(),
    reuse_clean: bool = False,
    line_breaks: bool = True,
    schema: T.StructType | None = None,
) -> BatchResult:
    """Run every step and write the clean table and all reports under `out_dir`.

    With `reuse_clean` a clean table of the same raw files and rules is taken as it is. `line_breaks` and
    `schema` are those of `read_raw_csv`. A failed gate raises `ValidationError` when
    the rules ask for it, for a missing column before any row is read; when they do not,
    a missing column counts as empty.
    """
    clean_path, tables = f"{out_dir}/clean", f"{out_dir}/tables"
    schema = schema or files.raw_schema(spark, raw_path)
    header = schema.names
    quality.enforce(quality.run_raw_header(spark, header, gates), gates)
    digest = versions.input_digest(spark, raw_path, limits, line_breaks, header)

    def raw_report(counts: dict[str, int]) -> DataFrame:
        rows = spark.range(1).select(F.lit(counts["raw_rows"]).cast("bigint").alias("raw_rows"))
        return quality.check_raw_counted(header, rows, gates)

    def rows_of() -> DataFrame:
        raw = files.read_raw_csv(spark, raw_path, schema, line_breaks, keep_malformed=True)
        return raw.withColumns({c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in header})

    made = clean_or_reuse(
        spark, rows_of, clean_path, digest, limits, reuse_clean, gate=lambda counts: quality.enforce(raw_report(counts), gates)
    )
    cleaned, summary = made.cleaned, made.summary
    if "note" not in summary.columns:
        summary = files.materialise(summary, f"{out_dir}/summary")
        files.write_report_csv(summary, tables, "cleaning_summary")

    analysed = files.read_clean(spark, clean_path)
    report = raw_report(made.counts).unionByName(quality.check_clean(analysed, gates))
    report = files.materialise(report, f"{out_dir}/validation")
    quality.enforce(report, gates)

    kpis = files.materialise(summaries.summary_kpis(analysed, reports), f"{out_dir}/kpis")
    outputs = {**summaries.run_eda(analysed, reports), "kpis": kpis, "validation": report}
    paths = {name: files.write_report_csv(rows, tables, name) for name, rows in outputs.items()}
    return BatchResult(cleaned, summary, report, kpis, paths)
