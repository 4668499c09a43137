"""Scratch tables, files that executors write themselves, and running totals.

Files other than Spark's own are written in two steps. A task writes under a name
that no other attempt uses and reports it in a row. `commit` then renames what the
written rows name and stores these rows as the manifest, which readers go by. So a
lost executor or a repeated task leaves files that no manifest names, never a half
file under a final name. The folder must be on storage that all executors share and
that pyarrow can open (a shared mount, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from catalens.sources.files import remove, shared_folder

ENTRY = T.StructType([
    T.StructField("shard", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("temporary", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_records", T.LongType()),
    T.StructField("n_items", T.LongType()),
])
ENTRY_ARROW = pa.schema([
    ("shard", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("temporary", pa.string()),
    ("n_bytes", pa.int64()), ("n_records", pa.int64()), ("n_items", pa.int64()),
])


_areas: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder path on shared storage, inside the innermost `scratch_area`."""
    return f"{_areas[-1]}/{uuid.uuid4().hex}" if _areas else shared_folder(spark)


@contextmanager
def scratch_area(spark: SparkSession) -> Iterator[str]:
    """Scratch tables made inside are removed at the end. What shall stay, frames that read
    them included, has to be written elsewhere before."""
    _areas.append(scratch(spark))
    try:
        yield _areas[-1]
    finally:
        remove(spark, _areas.pop())


def materialise(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, outlives executors."""
    spark = rows.sparkSession
    path = path or scratch(spark)
    rows.write.mode("overwrite").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    written._scratch = path  # for `discard`
    return written


def discard(written: DataFrame) -> None:
    """Remove the table of a frame that `materialise` gave, once nothing reads it any more."""
    remove(written.sparkSession, written._scratch)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def temporary_name() -> str:
    return f"temporary/{uuid.uuid4().hex}"


def commit(entries: DataFrame, folder: str) -> DataFrame:
    """Run the writing tasks, rename their files, store and return the manifest.

    `entries` has the columns of ENTRY. Renaming is done by tasks and may be repeated:
    a file that has its final name already stays.
    """
    spark = entries.sparkSession
    written = materialise(entries, f"{folder}/written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if store.get_file_info(old).type != pafs.FileType.NotFound:
                    store.move(old, new)
                elif store.get_file_info(new).size != row["n_bytes"]:
                    raise FileNotFoundError(f"neither {old} nor a whole {new}")
            yield batch

    manifest = materialise(written.mapInArrow(rename, ENTRY), f"{folder}/manifest")
    remove(spark, f"{folder}/temporary")  # what attempts left whose rows did not count
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(f"{folder}/manifest")


def running_total(rows: DataFrame, order: list[str], value: Column, before: str) -> DataFrame:
    """Adds `before`: the sum of `value` over all rows that come earlier in `order`.

    Rows go to ranges of `order`, are written, and summed per range; only one sum per
    range, not a row more, meets in one task. Equal rows get different values in any
    order. The input should be narrow.
    """
    spark = rows.sparkSession
    ranged = (
        rows.withColumn("_value", value.cast("long"))
        .repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
        .withColumn("_range", F.spark_partition_id())
    )
    ranged = materialise(ranged)
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    earlier = W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = (
        W.Window.partitionBy("_range")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(W.Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(offsets, "_range")
        .withColumn(before, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_range", "_value", "_offset")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by their first `keys` columns."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(k)[held.num_rows - 1] for k in range(keys)]
        if all(held.column(k)[0] == last[k] for k in range(keys)):
            continue
        low, high = 0, held.num_rows - 1  # first row of the last group
        while low < high:
            middle = (low + high) // 2
            if all(held.column(k)[middle] == last[k] for k in range(keys)):
                high = middle
            else:
                low = middle + 1
        yield held.slice(0, low).combine_chunks()
        held = held.slice(low)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
