"""Comma-separated tag columns: token rows and substring counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.parse import trim_white_space


def explode_tags(
    rows: DataFrame,
    tags: str = "genres",
    token: str = "genre",
    keep_empty: bool = False,
    trim: Callable[[Column], Column] = trim_white_space,
) -> DataFrame:
    """One row per (row, token). Repeated tokens of a row are all kept.

    `keep_empty` keeps tokens that are blank after trimming ("a,,b").
    """
    split = rows.filter(F.col(tags).isNotNull()).withColumn(token, F.explode(F.split(tags, ",", -1)))
    trimmed = split.withColumn(token, trim(F.col(token)))
    return trimmed if keep_empty else trimmed.filter(F.col(token) != "")


def per_listed_tag(
    rows: DataFrame,
    names: Iterable[str],
    measures: dict[str, Callable[[Column], Column]],
    tags: str = "genres",
    label: str = "genre",
) -> DataFrame:
    """Aggregate the rows whose tag text contains each listed name, ignoring case.

    This is a substring test ("Music" is in "Musical"), so a row can count for
    several names. All names share one scan and one aggregate row. A measure is
    a function from the hit test (TRUE or NULL per row) to an aggregate. Names
    without any hit are kept.
    """
    aggregates, results = [], []
    for i, name in enumerate(names):
        hit = F.when(F.lower(tags).contains(name.lower()), True)
        columns = {key: f"{key}_{i}" for key in measures}
        aggregates += [build(hit).alias(columns[key]) for key, build in measures.items()]
        results.append(F.struct(F.lit(name).alias(label), *[F.col(c).alias(k) for k, c in columns.items()]))
    return rows.agg(*aggregates).select(F.inline(F.array(*results)))
