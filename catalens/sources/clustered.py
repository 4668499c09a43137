"""Tables laid out so that narrow slices skip files and row groups.

Rows are ordered along a curve that interleaves the bits of several columns' ranks, so rows
that are near in all of them lie in few files, and Parquet's least and greatest values per
row group rule the others out. A rank is the number of cut points a value reaches; the cut
points part the rows evenly and come from quantile sketches, 2**BITS - 1 numbers a column.
Texts rank by their first six bytes. One shuffle by range writes the table. The sketches,
the sample behind the ranges and the shuffle each read the rows, so these are written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.sources.files import materialise, remove, shared_folder

BITS = 6
ACCURACY = 10_000


def _number(rows: DataFrame, column: str) -> Column:
    """The value as a number in the column's order."""
    if isinstance(rows.schema[column].dataType, T.StringType):
        digits = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double")
    if isinstance(rows.schema[column].dataType, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def curve(rows: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> Column:
    """The place on the curve; a null ranks first."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = rows.agg(*[F.percentile_approx(_number(rows, c), shares, ACCURACY).alias(c) for c in columns]).first()
    place = F.lit(0).cast("long")
    for k, column in enumerate(columns):
        cuts = sorted(set(found[column] or []))
        value = _number(rows, column)
        rank = F.lit(0) if not cuts else F.coalesce(
            F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= value)), F.lit(0)  # noqa: B023
        )
        for bit in range(bits):
            place = place + F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + k)
    return place


def write_clustered(
    rows: DataFrame, path: str, columns: tuple[str, ...] = ("release_year", "vote_count", "original_language"), files: int | None = None
) -> None:
    """The table as Parquet along the curve of `columns`, in about `files` files (by default
    as many as the session's shuffle partitions)."""
    spark = rows.sparkSession
    held = shared_folder(spark)
    rows = materialise(rows, held)
    rows = rows.withColumn("_place", curve(rows, columns))
    ranged = rows.repartitionByRange(files, "_place") if files else rows.repartitionByRange("_place")
    ordered = ranged.sortWithinPartitions("_place", *columns).drop("_place")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    remove(spark, held)
