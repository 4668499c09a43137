"""Top-k lists, global and per group, with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def descending(column: str, tiebreak: str = "id") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col(tiebreak).asc_nulls_last()]


def ascending(column: str, tiebreak: str = "id") -> list[Column]:
    return [F.col(column).asc_nulls_last(), F.col(tiebreak).asc_nulls_last()]


def top_n(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows. Every task keeps its own n best; nothing is sorted whole."""
    return rows.orderBy(*order).limit(n)


def top_n_per_group(
    rows: DataFrame, group: str, order: list[Column], n: int, position: str = "rn"
) -> DataFrame:
    """The first n rows of each group, numbered in `position`.

    Spark prunes to n rows per group inside every task before the shuffle, so a
    group that holds a third of the data still sends few rows.
    """
    numbered = rows.withColumn(position, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.filter(F.col(position) <= n)
