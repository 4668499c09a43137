"""Clean tables that know what they were made from, and bucketed ones that take deliveries.

A manifest is a small text file that is written under a temporary name and renamed when
the table's files are complete. It holds a digest of the inputs (path, size and time of
every file) and of the rules, so a table is reused only for the same inputs and rules.

`BucketTable` keeps one row per id in a fixed number of buckets. Its manifest names a
folder per bucket. A delivery is cleaned, its buckets are merged with the stored rows of
the same buckets and written to new folders, and the next version's manifest names these
and, for all other buckets, the folders of the version before. Readers go by a manifest,
so a run that breaks off leaves the old version whole, and files that no manifest names.
Renaming must be atomic, as on HDFS and mounted file systems, and one run may merge at a
time: the second of two runs that make the same version fails when it commits.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.operators import cleaning
from catalens.params import CleanRules
from catalens.schema import CLEAN_COLUMNS, CLEAN_SCHEMA
from catalens.sources import files

#: Of a table of some terabytes. A bucket is rewritten by one task, so aim at a few hundred MB.
BUCKETS = 4096
# What the labels of missing values hide; equal copies are told apart by it.
_ABSENT = {"_no_language": "original_language", "_no_countries": "production_countries"}
STORED = T.StructType([*CLEAN_SCHEMA, *[T.StructField(name, T.BooleanType()) for name in _ABSENT]])


# --- digests and manifests --------------------------------------------------


def input_digest(spark: SparkSession, path: str, *rules) -> str:
    """Of the path, length and time of every file under `path`, and of the rules.

    The files' figures are summed by Spark, whatever their order; no file is opened. Empty
    files do not count.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        F.xxhash64("path", "length", "modificationTime").alias("mark"), "length"
    )
    count, size, total, mixed = listed.agg(
        F.count("*"), F.sum("length"), F.sum(F.col("mark").cast("decimal(38,0)")), F.bit_xor("mark")
    ).first()
    plain = [asdict(r) if is_dataclass(r) else r for r in rules]
    text = json.dumps([count, size, str(total), mixed, plain], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Written beside its place first, then renamed. An existing one is an error."""
    system, there = files.file_system(spark, path)
    _, beside = files.file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if system.exists(there) or not system.rename(beside, there):
        system.delete(beside, False)
        raise FileExistsError(f"{path} was committed by another run")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    system, there = files.file_system(spark, path)
    if not system.exists(there):
        return None
    stream = system.open(there)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_clean(spark: SparkSession, staged: str, path: str, digest: str, counts: dict[str, int]) -> None:
    """Puts the written table `staged` in the place of the one at `path`, with what it was
    made from. Between the two renamings there is no table, and none is reused."""
    system, manifest = files.file_system(spark, f"{path}.manifest")
    _, old = files.file_system(spark, path)
    system.delete(manifest, False)
    system.delete(old, True)
    if not system.rename(files.file_system(spark, staged)[1], old):
        raise FileExistsError(f"{path} was written by another run")
    write_manifest(spark, f"{path}.manifest", {"digest": digest, "counts": counts})


def read_clean_made_from(spark: SparkSession, path: str, digest: str) -> tuple[DataFrame, dict[str, int]] | None:
    """The clean table at `path` and its counts, if it is whole and was made from these inputs and rules."""
    manifest = read_manifest(spark, f"{path}.manifest")
    if manifest is None or manifest["digest"] != digest:
        return None
    found = files.read_clean_if_present(spark, path)
    return None if found is None else (found, manifest["counts"])


# --- buckets ----------------------------------------------------------------


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    folders: dict[int, str]  # of every bucket that has rows, relative to the table
    deliveries: tuple[str, ...]  # digests of what is in it


class BucketTable:
    """A clean table at `path` that grows by deliveries."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:08d}.json"

    def newest(self) -> Version | None:
        """The last committed version; versions are numbered from 1 without gaps."""
        system, there = files.file_system(self.spark, f"{self.path}/versions")
        if not system.exists(there):
            return None
        names = [status.getPath().getName() for status in system.listStatus(there)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        return self.version(max(numbers)) if numbers else None

    def version(self, number: int) -> Version:
        found = read_manifest(self.spark, self._manifest(number))
        if found is None:
            raise FileNotFoundError(f"{self.path} has no version {number}")
        folders = {int(bucket): folder for bucket, folder in found["folders"].items()}
        return Version(number, found["buckets"], folders, tuple(found["deliveries"]))

    def _rows(self, version: Version | None, only: set[int] | None = None) -> DataFrame:
        folders = [f for b, f in (version.folders if version else {}).items() if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """The clean table, as of a version or the newest one."""
        return self._rows(self.version(number) if number else self.newest()).select(*CLEAN_COLUMNS)

    def merge(self, raw: DataFrame, limits: CleanRules = CleanRules(), digest: str | None = None) -> Version:
        """The next version: the best copy of every id over all deliveries so far.

        A delivery whose digest is in the table already changes nothing. Only buckets with
        an admissible row of the delivery are rewritten.
        """
        before = self.newest()
        if before and digest and digest in before.deliveries:
            return before
        buckets = before.buckets if before else self.buckets
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        delivered = raw.transform(cleaning.typed).transform(cleaning.admissible, limits)
        delivered = files.materialise(delivered.transform(cleaning.best_copy).withColumn("_bucket", bucket), files.shared_folder(self.spark))
        touched = {r["_bucket"] for r in delivered.select("_bucket").distinct().collect()}  # one number per bucket
        stored = self._rows(before, touched).withColumn("_bucket", bucket)
        stored = stored.withColumns({c: F.when(~F.col(flag), F.col(c)) for flag, c in _ABSENT.items()})
        columns = delivered.columns
        # One shuffle, by bucket, serves the choice of copies and the writing.
        rows = delivered.unionByName(stored.select(*columns)).repartition(max(1, len(touched)), "_bucket")
        best = cleaning.best_copy(rows, "_bucket")
        flags = {flag: F.col(c).isNull() for flag, c in _ABSENT.items()}
        kept = cleaning.enriched(best.withColumns(flags), "_bucket", *flags)
        data = f"data/{uuid.uuid4().hex}"
        writer = kept.select("_bucket", *STORED.names).write.option("compression", "zstd")
        writer.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        folders = dict(before.folders) if before else {}
        folders |= {b: f"{data}/_bucket={b}" for b in touched}
        deliveries = [*(before.deliveries if before else ()), *([digest] if digest else [])]
        number = before.number + 1 if before else 1
        content = {"buckets": buckets, "folders": folders, "deliveries": deliveries}
        write_manifest(self.spark, self._manifest(number), content)
        return self.version(number)

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions but the newest `keep`, and the data folders that none of these names."""
        newest = self.newest()
        if newest is None:
            return
        numbers = range(max(1, newest.number - keep + 1), newest.number + 1)
        named = {folder.split("/")[1] for n in numbers for folder in self.version(n).folders.values()}
        system, there = files.file_system(self.spark, f"{self.path}/data")
        for status in system.listStatus(there):
            if status.getPath().getName() not in named:
                system.delete(status.getPath(), True)
        for n in range(1, numbers[0]):
            system.delete(files.file_system(self.spark, self._manifest(n))[1], False)
