"""Runtime and rating buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and right-closed upper bound in minutes, in order.
RUNTIME_BUCKETS = (
    ("0-60", 60), ("61-90", 90), ("91-120", 120), ("121-150", 150),
    ("151-180", 180), ("180+", None),
)
# Label, lowest and highest minute (both included) of the ranges.
RUNTIME_RANGES = (
    ("0-60 min", 0, 60), ("61-90 min", 61, 90), ("91-120 min", 91, 120),
    ("121-150 min", 121, 150), ("151-180 min", 151, 180), ("180+ min", None, 180),
)
# Labels of the runtime categories.
SHORT, MEDIUM = "Short (< 1hr)", "Medium (1-1.5hr)"
LONG, VERY_LONG = "Long (1.5-2.5hr)", "Very Long (> 2.5hr)"


def _chain(branches) -> Column:
    """CASE over (condition, value) pairs; the first true condition wins."""
    (condition, value), *rest = branches
    case = F.when(condition, value)
    for condition, value in rest:
        case = case.when(condition, value)
    return case


def runtime_bucket_position(runtime: Column) -> Column:
    """1-based position in RUNTIME_BUCKETS; every positive runtime has one."""
    return _chain(
        (F.lit(True) if top is None else runtime <= top, F.lit(i))
        for i, (_, top) in enumerate(RUNTIME_BUCKETS, start=1)
    )


def runtime_bucket_label(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label, _ in RUNTIME_BUCKETS]), position)


def runtime_range(runtime: Column) -> Column:
    """Range label; a fraction between two ranges (60.5) has none."""
    return _chain(
        (runtime > high if low is None else runtime.between(low, high), F.lit(label))
        for label, low, high in RUNTIME_RANGES
    )


def runtime_category(runtime: Column) -> Column:
    """Category label; a fraction between 90 and 91 has none."""
    return _chain([
        (runtime < 60, F.lit(SHORT)),
        (runtime.between(60, 90), F.lit(MEDIUM)),
        (runtime.between(91, 150), F.lit(LONG)),
        (runtime > 150, F.lit(VERY_LONG)),
    ])


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based equal-width bin; the upper bound belongs to the last bin."""
    bucket = F.width_bucket(value, F.lit(low).cast("double"), F.lit(high).cast("double"), F.lit(bins))
    return F.least(bucket, F.lit(bins).cast("bigint"))
