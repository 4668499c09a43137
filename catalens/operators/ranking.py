"""Ranks, neighbours and percentiles without sorting everything in one task.

A plain window over the whole table, or over a genre that holds a third of it,
would put all those rows into one task. The lists below are all cut to their
first n rows, and the window value of those rows depends only on rows before
them (or one row after), so each operator cuts first and runs the window on the
few rows left. Where that is not enough, ranks are taken over distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.operators.topk import descending, top_n


def ranked_head(rows: DataFrame, by: str, n: int, tiebreak: str = "id") -> DataFrame:
    """First n rows by `by` descending, with `rank` and `dense_rank`.

    A rank counts only better rows, and these all come before the row itself.
    """
    over = Window.orderBy(F.col(by).desc_nulls_last())
    return top_n(rows, descending(by, tiebreak), n).withColumns({
        "rank": F.rank().over(over),
        "dense_rank": F.dense_rank().over(over),
    })


def best_values_per_group(rows: DataFrame, group: str, by: str, n: int) -> DataFrame:
    """The n highest distinct values of each group with `rank` and `dense_rank`.

    Rows are counted per (group, value) first, with partial counts in every
    task, so equal rows never meet in one place.
    """
    counts = rows.groupBy(group, by).agg(F.count("*").alias("_rows"))
    best_first = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last())
    above = F.sum("_rows").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
    return (
        counts.withColumn("dense_rank", F.row_number().over(best_first))
        .filter(F.col("dense_rank") <= n)
        .withColumn("rank", (F.coalesce(above, F.lit(0)) + 1).cast("int"))
        .drop("_rows")
    )


def rank_per_group(rows: DataFrame, group: str, by: str, n: int, kind: str = "rank") -> DataFrame:
    """Every row whose rank (`rank` or `dense_rank`) in its group is at most n.

    All ties are kept, however many there are. The best values of each group are found
    from counts per (group, value) and joined back to the rows by group and value, so
    rows are never shuffled by the group alone. There are at most n values per group,
    few enough for Spark to broadcast them by their size.
    """
    values = best_values_per_group(rows, group, by, n).filter(F.col(kind) <= n)
    values = values.select(F.col(group).alias("_group"), F.col(by).alias("_value"), kind)
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col(by).eqNullSafe(F.col("_value"))
    return rows.join(values, same).drop("_group", "_value")


def next_in_group(
    rows: DataFrame, group: str, order: list[Column], value: str, n: int, name: str
) -> DataFrame:
    """First n rows in (group, order) with the `value` of the following row.

    One row more than n is kept, as the last row may need its successor.
    """
    whole_order = [F.col(group).asc_nulls_last(), *order]
    head = top_n(rows, whole_order, n + 1)
    over = Window.partitionBy(group).orderBy(*order)
    return top_n(head.withColumn(name, F.lead(value).over(over)), whole_order, n)


def previous_in_group(
    rows: DataFrame, group: str, order: list[Column], value: str, n: int, name: str
) -> DataFrame:
    """First n rows in (group, order) with the `value` of the preceding row."""
    head = top_n(rows, [F.col(group).asc_nulls_last(), *order], n)
    over = Window.partitionBy(group).orderBy(*order)
    return head.withColumn(name, F.lag(value).over(over))


def ranked_head_per_group(
    rows: DataFrame, group: str, by: str, n: int, mean_of: str, tiebreak: str = "id"
) -> DataFrame:
    """First n rows in (group, best first) with `dense_rank` and the group's mean.

    The mean needs the whole group: it is a partial aggregate over all rows,
    joined to the n rows.
    """
    head = top_n(rows, [F.col(group).asc_nulls_last(), *descending(by, tiebreak)], n)
    over = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last())
    head = head.withColumn("dense_rank", F.dense_rank().over(over))
    means = rows.groupBy(F.col(group).alias("_group")).agg(F.avg(mean_of).alias("group_mean"))
    # `head` has n rows, a fixed number, so it is safe to send to every task.
    same = F.col(group).eqNullSafe(F.col("_group"))
    return means.join(F.broadcast(head), same).drop("_group")


def percent_rank_head(rows: DataFrame, by: str, n: int, name: str, tiebreak: str = "id") -> DataFrame:
    """Top n rows by `by` with their ascending percent rank over all rows.

    percent_rank = (rows with a smaller value) / (all rows - 1). Values above
    the smallest listed one are all in the list; of the smallest, all equal rows
    must be counted in the full data, together with the total, in one aggregate.
    The list, n rows, is fetched first, so `rows` is computed twice and not three
    times. `by` must not be NULL.
    """
    spark = rows.sparkSession
    listed = top_n(rows, descending(by, tiebreak), n).collect()
    head = spark.createDataFrame(listed, rows.schema)
    if not listed:
        return head.withColumn(name, F.lit(None).cast("double"))
    lowest = F.lit(listed[-1][by])
    total, from_lowest = rows.agg(F.count("*"), F.count_if(F.col(by) >= lowest)).first()
    at_least = F.count("*").over(Window.orderBy(F.col(by).desc()))
    smaller = F.lit(total) - F.when(F.col(by) == lowest, F.lit(from_lowest)).otherwise(at_least)
    share = smaller / (total - 1) if total > 1 else F.lit(0.0)
    return head.withColumn(name, share)
