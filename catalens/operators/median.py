"""Exact medians of columns with few and with many distinct values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# percentile_approx misses a rank by at most rows / ACCURACY; the bracket around
# the middle is several times wider than that.
ACCURACY = 20_000
MARGIN = 5 / ACCURACY
# Distinct values that may be ordered in one task.
SMALL = 100_000


def _known(column: str) -> Column:
    """The value as a double; NULL and NaN count as no value."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def aggregate_with_median(
    rows: DataFrame, column: str, name: str, aggregates: Iterable[Column] = ()
) -> DataFrame:
    """One row: the aggregates, and the exact median of `column` as `name`, in one pass.

    For columns with few distinct values, such as whole minutes: every task counts the
    rows per distinct value. For others take `exact_median`. NULL and NaN are ignored;
    no values give NULL.
    """
    return rows.agg(*aggregates, F.median(_known(column)).alias(name))


def exact_median(rows: DataFrame, column: str, small: int = SMALL, margin: float = MARGIN) -> DataFrame:
    """One row, one column `median`, for a column with any number of distinct values.

    A sketch brackets the middle, the rows beside and inside the bracket are counted, and
    so on inside it until at most `small` rows, or one value, are left. Only their
    distinct values are ordered in one task. A bracket that misses a middle position is
    widened, at last to all values. NULL and NaN are ignored; no values give NULL.
    """
    values = rows.select(_known(column).alias("v")).filter("v IS NOT NULL")
    low, high, inside = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    below, lower, upper = 0, (inside + 1) // 2, inside // 2 + 1
    while inside > small and low < high:
        wide, now = margin, values.filter(F.col("v").between(low, high))
        while True:
            shares = [(lower - below) / inside - wide, (upper - below) / inside + wide]
            shares = [min(1.0, max(0.0, share)) for share in shares]
            first, last = now.agg(F.percentile_approx("v", shares, ACCURACY)).first()[0]
            if wide >= 1:
                first, last = low, high
            under, within = now.agg(F.count_if(F.col("v") < first), F.count_if(F.col("v").between(first, last))).first()
            if below + under < lower and upper <= below + under + within:
                break
            wide = max(0.0, wide) * 8 + 1 / ACCURACY
        if within == inside:
            break
        low, high, below, inside = first, last, below + under, within
    counts = values.filter(F.col("v").between(low, high)) if low is not None else values
    so_far = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.groupBy("v").agg(F.count("*").alias("n")).select("v", (F.sum("n").over(so_far) + below).alias("upto"))

    def value_at(position: int) -> Column:
        return F.min(F.when(F.col("upto") >= position, F.col("v")))

    return placed.agg(((value_at(lower) + value_at(upper)) / 2).alias("median"))
