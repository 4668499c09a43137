"""The most frequent values, exactly, without shuffling all values.

Every task counts its values in a summary of bounded size: when there are more than
`tracked` of them, the count of the first one beyond is taken off all, which drops the rare
ones, and what was taken off is the task's error. Merged, a value's count is at least the
sum of its counts and at most that plus the sum of all errors. Where no task had to drop
anything, the merged counts are exact and done. Otherwise the best merged values are
counted in a second pass; if the n-th of them has more rows than any other value can have,
the list is proven. Only where that fails are all values counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.operators.topk import descending, top_n

#: Values a task keeps, and values that are counted in the second pass.
TRACKED, RECOUNTED = 4096, 16384


def reduce_counts(counts: Counter, tracked: int) -> int:
    """Keeps the `tracked` most frequent values; returns what was taken off the counts."""
    if len(counts) <= tracked:
        return 0
    off = sorted(counts.values(), reverse=True)[tracked]
    for value in [v for v, n in counts.items() if n <= off]:
        del counts[value]
    for value in counts:
        counts[value] -= off
    return off


def summaries(rows: DataFrame, column: str, tracked: int) -> DataFrame:
    """value, n and error (rows with an error have no value) from every task."""
    schema = T.StructType([
        T.StructField("value", rows.schema[column].dataType), T.StructField("n", T.LongType()), T.StructField("error", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error, kind = Counter(), 0, None
        for batch in batches:
            kind = batch.column(0).type
            for pair in pc.value_counts(batch.column(0)):
                held[pair["values"].as_py()] += pair["counts"].as_py()
            if len(held) > 2 * tracked:  # seldom, so that a long run of rare values costs little
                error += reduce_counts(held, tracked)
        error += reduce_counts(held, tracked)
        if kind is not None:
            values, counts = [*held, None], [*held.values(), None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind), pa.array(counts, pa.int64()), pa.array([None] * len(held) + [error], pa.int64())], names=schema.names
            )

    return rows.select(column).mapInArrow(run, schema)


def top_counts(
    rows: DataFrame, column: str, n: int, name: str = "movie_count", tracked: int = TRACKED, recounted: int = RECOUNTED
) -> DataFrame:
    """The n most frequent values (null is one) with their counts; ties by value, nulls last."""
    order = descending(name, column)
    merged = summaries(rows, column, tracked).groupBy("value", F.col("error").isNotNull().alias("is_error"))
    merged = merged.agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    # Errors and values share one pass; a bounded number of rows comes back.
    best = merged.orderBy(F.desc("is_error"), F.desc_nulls_last("n"), F.col("value").asc_nulls_last()).limit(max(n, recounted) + 2).collect()
    error = next((r["error"] for r in best if r["is_error"]), 0)
    values = [r for r in best if not r["is_error"]]
    kind = T.StructType([T.StructField(column, rows.schema[column].dataType), T.StructField(name, T.LongType())])
    if error == 0:  # merged counts are the counts
        return top_n(rows.sparkSession.createDataFrame([(r["value"], r["n"]) for r in values[:n]], kind), order, n)
    # A value that is not among these has at most so many rows.
    others = error + (values[recounted]["n"] if len(values) > recounted else 0)
    listed = rows.sparkSession.createDataFrame([(r["value"],) for r in values[:recounted]], T.StructType([kind[0]]))
    same = F.col(column).eqNullSafe(F.col("_value"))
    matching = rows.select(column).join(F.broadcast(listed.select(F.col(column).alias("_value"))), same, "left_semi")
    first = top_n(matching.groupBy(column).agg(F.count("*").alias(name)), order, n).collect()
    if len(first) == n and first[-1][name] > others:
        return top_n(rows.sparkSession.createDataFrame(first, kind), order, n)
    return _counted(rows, column, n, name)


def _counted(rows: DataFrame, column: str, n: int, name: str) -> DataFrame:
    return top_n(rows.groupBy(column).agg(F.count("*").alias(name)), descending(name, column), n)
