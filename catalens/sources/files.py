"""Files in and out: the raw CSV, the clean Parquet table, small CSV reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.schema import ANALYSIS_COLUMNS, CLEAN_SCHEMA, text_schema
from catalens.sources import split_csv

# Quotes inside quoted text are doubled.
_CSV = {"header": True, "quote": '"', "escape": '"'}
# Blanks around a value are data: leave them to the cleaning rules.
_CSV_WRITE = {**_CSV, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# The folder of a session on one machine; it goes when Python ends.
_own_folder: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """A new, unused folder path on the storage all executors share.

    The place is the one the cluster names in `spark.checkpoint.dir`. Where that is
    unset on one machine (a `local` master), a temporary folder is set instead, which is
    removed at the end of the process; on a cluster it is an error. What a caller writes
    there is the caller's to remove, with `remove`.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not _on_one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folder.append(tempfile.TemporaryDirectory(prefix="run-", ignore_cleanup_errors=True))
        spark.sparkContext.setCheckpointDir(_own_folder[-1].name)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/catalens-{uuid.uuid4().hex}"


def _on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path as it wants it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = file_system(spark, path)
    return system.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `shared_folder` gave, once nothing reads it any more."""
    system, there = file_system(spark, path)
    system.delete(there, True)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a write inside shuffles is removed when the write ends, not when the driver happens to
    collect its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def raw_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names from the header, all typed as text; only the header is read."""
    return text_schema(spark.read.options(**_CSV).csv(path).columns)


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = True, keep_malformed: bool = False
) -> DataFrame:
    """The raw files as text columns; lines with a wrong number of fields are skipped.

    The header of every file must name the columns in the same order, else reading
    fails. Files are read in splits, also where texts hold line breaks (see `split_csv`);
    that takes a pass of its own over files of more than one split, at once, and its small
    table stays in the shared folder for as long as the frame is used. Where no text holds
    a line break, `line_breaks=False` saves that pass. With `keep_malformed` skipped lines
    stay as rows whose column `_malformed` has their text.
    """
    schema = schema or raw_schema(spark, path)
    if not line_breaks:
        return _read_lines(spark, path, schema, keep_malformed)
    states = materialise(split_csv.split_states(spark, path), shared_folder(spark))
    return split_csv.parse(split_csv.records(spark, path, schema.names, states), schema.names, keep_malformed)


def read_whole_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As `read_raw_csv`, with each file in one task."""
    return _csv_reader(spark, "DROPMALFORMED", multiLine=True).schema(schema).csv(path)


def _csv_reader(spark: SparkSession, mode: str, **options):
    # Without column pruning a count, too, sees which lines are malformed.
    return spark.read.options(**_CSV, mode=mode, enforceSchema=False, columnPruning=False, **options)


def _read_lines(spark: SparkSession, path: str, schema: T.StructType, keep_malformed: bool) -> DataFrame:
    if not keep_malformed:
        return _csv_reader(spark, "DROPMALFORMED").schema(schema).csv(path)
    wider = T.StructType([*schema, T.StructField(split_csv.MALFORMED, T.StringType())])
    return _csv_reader(spark, "PERMISSIVE", columnNameOfCorruptRecord=split_csv.MALFORMED).schema(wider).csv(path)


def write_raw_csv(rows: DataFrame, path: str) -> None:
    """Text rows as CSV files that `read_raw_csv` reads back unchanged."""
    rows.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def write_clean(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_clean(
    spark: SparkSession, path: str, columns: Iterable[str] | None = ANALYSIS_COLUMNS
) -> DataFrame:
    """The clean table; by default only the columns the reports need."""
    rows = spark.read.parquet(path)
    return rows if columns is None else rows.select(*columns)


def read_clean_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The clean table of an earlier, finished run, or None.

    A run that broke off leaves no success marker; its files count as absent.
    """
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None


def materialise(rows: DataFrame, path: str) -> DataFrame:
    """Write the table and return it as read back.

    Later work then starts from files that outlive any executor, not from a
    cache that is lost with it.
    """
    write_clean(rows, path)
    return rows.sparkSession.read.parquet(path)


def write_anew(spark: SparkSession, path: str) -> DataFrame:
    """The same table from new files: written beside its place, which they then take."""
    beside = f"{path}.{uuid.uuid4().hex}"
    write_clean(spark.read.parquet(path), beside)
    remove(spark, path)
    system, there = file_system(spark, path)
    if not system.rename(file_system(spark, beside)[1], there):
        raise FileExistsError(f"{path} was written by another run")
    return spark.read.parquet(path)


def conform(rows: DataFrame, schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """Columns of `schema`, in its order and with its types."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def register_view(rows: DataFrame, name: str = "movies") -> None:
    rows.createOrReplaceTempView(name)


def write_report_csv(rows: DataFrame, folder: str, name: str) -> str:
    """An aggregated report as one CSV file in `folder/name`; returns its path.

    One task writes all rows, so this is for reports, not for tables that grow with the
    input; those go through `export_clean_csv`.
    """
    path = f"{folder}/{name}"
    rows.coalesce(1).write.mode("overwrite").options(**_CSV_WRITE).csv(path)
    return path


def export_clean_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """The clean table as CSV files for loading into another system."""
    rows.write.mode("overwrite").options(**_CSV_WRITE, sep=sep).csv(path)


def preview(rows: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(key).asc_nulls_last()).limit(n)
