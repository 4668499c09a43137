"""Exact k-means over integer vectors, with distances bounded in a rotated space.

Every component x becomes floor(scale * x). The principal axes of all vectors (from
summed moments) give a rotation; each vector is stored once with its leading rotated
coordinates, as many as explain a given share of the variance, and the norm of the rest.
The squared distance of two vectors is at
least that of the leading coordinates plus the squared difference of the rest norms. So
per vector the centroid with the smallest bound is measured first, and then only those
whose bound does not exceed that distance, all in 64-bit integers. Bounds carry a margin
for rounding, and ties go to the smaller number, so the result is that of measuring
every centroid, whatever the rotation.

Each round sums the integer vectors of every cluster: one partial sum per task, added by
Spark as decimals, and `k` rows of a vector's length reach the driver. A round that
changes no centroid ends the loop, as all further ones would repeat it.

Vectors that are null, of another length, or hold null or non-finite components are left
out. Components beyond +-LIMIT after scaling are an error, as distances would not fit
into 64 bits. Equal vectors, and rows with equal ids, are separate members; of starting
vectors with equal hashes the one with the smaller components (compared as bytes) comes
first. A null id is hashed as an empty string. With fewer vectors than `k` there are fewer
centroids; an empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import materialise

LIMIT = 1 << 27  # 64 squared differences of 2 * LIMIT fit into a long

_STORED = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("units", T.BinaryType()),
    T.StructField("lead", T.BinaryType()),
    T.StructField("rest", T.DoubleType()),
])
_MOMENT = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("value", T.DoubleType())])
_SUM = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("dimension", T.IntegerType()), T.StructField("value", T.LongType()),
])
ASSIGNED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
])


def whole_vectors(vectors: DataFrame, dimensions: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return rows.where((F.size("vector") == dimensions) & finite)


def _units(column: pa.Array, dimensions: int, scale: float) -> np.ndarray:
    units = np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, dimensions) * scale)
    if len(units) and np.abs(units).max() > LIMIT:
        raise OverflowError(f"scaled components must lie within +-{LIMIT}")
    return units.astype(np.int64)


@dataclass(frozen=True)
class Rotation:
    """The principal axes around the mean; columns of `axes` in descending variance."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (units - self.mean) @ self.axes
        return np.ascontiguousarray(turned[:, : self.leading]), np.linalg.norm(turned[:, self.leading :], axis=1)


def fit_rotation(vectors: DataFrame, dimensions: int, scale: float, explained: float) -> Rotation:
    """From the summed first and second moments of all vectors (see `whole_vectors`)."""
    upper = np.triu_indices(dimensions)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = 0, np.zeros(dimensions), np.zeros((dimensions, dimensions))
        for batch in batches:
            units = _units(batch.column(0), dimensions, scale).astype(np.float64)
            count, total, square = count + len(units), total + units.sum(axis=0), square + units.T @ units
        values = np.concatenate([[count], total, square[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=_MOMENT.names)

    summed = vectors.select("vector").mapInArrow(moments, _MOMENT).groupBy("entry").agg(F.sum("value")).collect()
    values = np.zeros(1 + dimensions + len(upper[0]))
    for entry, value in summed:
        values[entry] = value
    count = max(values[0], 1.0)
    mean = np.rint(values[1 : 1 + dimensions] / count)
    covariance = np.zeros((dimensions, dimensions))
    covariance[upper] = values[1 + dimensions :]
    covariance = (covariance + np.triu(covariance, 1).T) / count - np.outer(mean, mean)
    variances, axes = np.linalg.eigh(covariance)
    shares = np.cumsum(np.maximum(variances[::-1], 0))
    leading = int(np.searchsorted(shares, explained * shares[-1])) + 1
    return Rotation(mean, axes[:, ::-1].copy(), min(leading, dimensions))


def store(vectors: DataFrame, rotation: Rotation, dimensions: int, scale: float) -> DataFrame:
    """vec_id, units (32-bit integers), lead (floats), rest of every vector, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1), dimensions, scale)
            lead, rest = rotation(units)
            packed = [pa.array(map(bytes, rows), pa.binary()) for rows in (units.astype("<i4"), lead.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed, pa.array(rest)], names=_STORED.names)

    return materialise(vectors.mapInArrow(run, _STORED))


def first_centroids(stored: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of their ids."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = stored.select(F.sha2(text.cast("binary"), 256).alias("hash"), "units").orderBy("hash", "units").limit(k)
    return np.array([np.frombuffer(r["units"], "<i4") for r in chosen.collect()], np.int64)


def _packed(column: pa.Array, kind: str, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(count, -1)


class Nearest:
    """The nearest centroid of integer vectors, by bounds and then integers."""

    def __init__(self, centroids: np.ndarray, rotation: Rotation):
        self.centroids = centroids
        self.lead, self.rest = rotation(centroids)
        self.measured = self.seen = 0

    def __call__(self, units: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance, per vector."""
        own, other = (lead**2).sum(axis=1)[:, None], (self.lead**2).sum(axis=1)
        bound = own + other - 2 * (lead @ self.lead.T) + (rest[:, None] - self.rest) ** 2
        # The rounding of stored coordinates, to 24 bits, is below a millionth of the terms that were added.
        bound -= 1e-6 * (own + other + rest[:, None] ** 2 + self.rest**2) + 1e-6
        cluster = bound.argmin(axis=1)
        distance = self._measure(units, self.centroids[cluster])
        open_ = bound <= distance[:, None]
        open_[np.arange(len(units)), cluster] = False
        for k in range(len(self.centroids)):
            rows = np.flatnonzero(open_[:, k])
            exact = self._measure(units[rows], self.centroids[k])
            better = (exact < distance[rows]) | (exact == distance[rows]) & (k < cluster[rows])
            cluster[rows[better]], distance[rows[better]] = k, exact[better]
        self.seen += len(units) * len(self.centroids)
        return cluster, distance

    def _measure(self, units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        self.measured += len(units)
        return ((units - centroids) ** 2).sum(axis=1)


def _assigned(batch: pa.RecordBatch, nearest: Nearest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = _packed(batch.column("units"), "<i4", batch.num_rows).astype(np.int64)
    lead = _packed(batch.column("lead"), "<f4", batch.num_rows).astype(np.float64)
    return units, *nearest(units, lead, np.asarray(batch.column("rest")))


def next_centroids(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Floored means of the vectors nearest to each centroid; empty clusters keep theirs."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, held = Nearest(centroids, rotation), np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            units, cluster, _ = _assigned(batch, nearest)
            for own in range(k):
                rows = units[cluster == own]
                held[own, :-1] += rows.sum(axis=0)
                held[own, -1] += len(rows)
        used = np.flatnonzero(held[:, -1])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, dimensions + 1), pa.int32()), pa.array(np.tile(np.arange(dimensions + 1), len(used)), pa.int32()),
            pa.array(held[used].reshape(-1)),
        ], names=_SUM.names)

    partial = stored.select("units", "lead", "rest").mapInArrow(sums, _SUM)
    total = partial.groupBy("cluster", "dimension").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    found = {(r["cluster"], r["dimension"]): int(r["total"]) for r in total.collect()}
    moved = centroids.copy()
    for own in {cluster for cluster, _ in found}:
        count = found[own, dimensions]
        moved[own] = [found[own, d] // count for d in range(dimensions)]
    return moved


def assign(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> DataFrame:
    """vec_id, cluster, distance (squared) of every stored vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, rotation)
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = _assigned(batch, nearest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=ASSIGNED.names
                )

    return stored.mapInArrow(run, ASSIGNED)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: float = 1024.0, seed: int = 3, explained: float = 0.75,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector that takes part, and the final centroids."""
    whole = whole_vectors(vectors, dimensions, id_column, vector_column)
    rotation = fit_rotation(whole, dimensions, scale, explained)
    stored = store(whole, rotation, dimensions, scale)
    centroids = first_centroids(stored, k, seed)
    if not len(centroids):
        return stored.sparkSession.createDataFrame([], ASSIGNED), centroids
    for _ in range(rounds):
        moved = next_centroids(stored, centroids, rotation)
        if (moved == centroids).all():
            break
        centroids = moved
    return materialise(assign(stored, centroids, rotation)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and the sha256 of each row's centroid."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    total = sum(int(r["sum"]) for r in sums)
    rows = [
        (r["cluster"], int(r["sum"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in sums
    ]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
