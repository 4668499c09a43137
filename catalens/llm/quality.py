"""A quality classifier over statistics of the text alone.

One pass over the texts gives each document's statistics (lengths, shares of kinds of
characters, repetition). Standardised, they go through random Fourier features, which
approximate a Gaussian kernel, and ridge regression: every partition of the labelled
rows sums its part of the normal equations per fold, the sums are added up by Spark,
and only these matrices of fixed size reach the driver. Isotonic calibration is fitted
on scores of models that did not see the row, over a histogram of fixed size.

Null and empty texts have statistics (zeros) and so a score. Of several labels of one
id the mean counts; null labels count as none. Without labels every score is 0.5, with
one class all scores are that class's. Repeated rows score alike, a null id is kept,
extra columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import materialise
from catalens.llm.wordhash import gram_hashes, slices, text_bytes, words_of

KINDS = 9  # lower, upper, digit, blank, line break, sentence marks, ! and ?, other signs, beyond ASCII
_KIND = np.full(256, 8, np.uint8)
_KIND[:128] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 3, 4
_KIND[[ord(c) for c in ".,;:'\"-()"]], _KIND[[33, 63]] = 5, 6

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "line_breaks", "marks", "calls", "signs", "beyond_ascii",
    "short_words", "long_words", "distinct_words", "distinct_pairs", "words_per_line",
)
FOLDS = 4
#: Matrices of so many groups of tasks are added side by side.
LANES = 256
BINS = 2048


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    out = []
    for start, stop in slices(texts):
        data, offsets = text_bytes(texts.slice(start, stop - start))
        n, size = len(offsets) - 1, np.diff(offsets)
        of = np.repeat(np.arange(n, dtype=np.int64) * KINDS, size)
        kinds = np.bincount(of + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
        hashes, lengths, firsts = words_of(data, offsets)
        words = np.diff(firsts)
        pairs = gram_hashes(hashes, 2)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (lengths, lengths <= 3, lengths >= 14)]
        total, short, long = ([s[b] - s[a] for a, b in zip(firsts, firsts[1:])] for s in sums)
        alone = np.array([len(np.unique(hashes[a:b])) for a, b in zip(firsts, firsts[1:])])
        twos = np.array([len(np.unique(pairs[a : max(a, b - 1)])) for a, b in zip(firsts, firsts[1:])])
        letters, solid = np.maximum(kinds[:, 0] + kinds[:, 1], 1), np.maximum(size - kinds[:, 3] - kinds[:, 4], 1)
        many = np.maximum(words, 1)
        out.append(np.stack([
            np.log1p(size), np.log1p(words), np.array(total) / many, kinds[:, 1] / letters, kinds[:, 2] / solid,
            kinds[:, 4] / many, kinds[:, 5] / solid, kinds[:, 6] / solid, kinds[:, 7] / solid, kinds[:, 8] / solid,
            np.array(short) / many, np.array(long) / many, alone / many, twos / np.maximum(words - 1, 1),
            np.log1p(words / (kinds[:, 4] + 1)),
        ], axis=1))
    return np.concatenate(out) if out else np.empty((0, len(STATISTICS)))


@dataclass(frozen=True)
class Model:
    """Small arrays of fixed size; scores texts on any executor."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # of all labelled rows
    points: np.ndarray  # isotonic: raw score
    values: np.ndarray  # and calibrated score

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.clip(np.interp(self.expand(x) @ self.weights, self.points, self.values), 0, 1)


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics, written to the shared folder."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(statistics(batch.column(1)))], names=schema.names)

    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(text.mapInArrow(run, schema))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def isotonic(points: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order; block centres and means."""
    blocks: list[list[float]] = []  # weight, label sum, point sum
    for p, y, n in zip(points, labels, counts):
        blocks.append([n, y, p * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on the rows of `stats` (see `document_statistics`) that have a label.

    `labels`: doc_id, quality. `features` random cosines of a Gaussian kernel of `width`
    standard deviations; `ridge` is the penalty per labelled row.
    """
    random = np.random.RandomState(seed)
    d = len(STATISTICS)
    directions, phases = random.normal(0, 1 / width, (d, features)), random.uniform(0, 2 * np.pi, features)
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = label.agg(F.avg(F.col("quality").cast("double")).alias("label"))
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = materialise(stats.join(label, "doc_id").select(F.pmod(F.floor(crc / 3), F.lit(FOLDS)).cast("int").alias("fold"), "label", "stats"))

    moments = rows.agg(F.count("*"), *[
        f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)
    ]).first()
    blank = Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return blank
    rounded = np.array([float(f"{v:.6g}") for v in moments[1:]])
    scale = np.where(rounded[1::2] > 1e-9, rounded[1::2], 1.0)
    start = Model(rounded[::2], scale, directions, phases, blank.weights, blank.points, blank.values)

    part = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("lane", T.IntegerType()), T.StructField("sums", T.BinaryType())])
    arrow = pa.schema([("fold", pa.int32()), ("lane", pa.int32()), ("sums", pa.binary())])
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            fold, y, z = np.asarray(batch.column(0)), np.asarray(batch.column(1)), start.expand(_matrix(batch.column(2)))
            for k in range(FOLDS):
                own = z[fold == k]
                held[k] += own.T @ np.concatenate([own, y[fold == k, None]], axis=1)
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_pylist([{"fold": k, "lane": lane, "sums": held[k].tobytes()} for k in range(FOLDS)], arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                held[k] = held.get(k, 0) + np.frombuffer(data.as_buffer(), np.float64)
        yield pa.RecordBatch.from_pylist([{"fold": k, "lane": 0, "sums": v.tobytes()} for k, v in held.items()], arrow)

    # A tree: the matrices of many tasks are added in lanes, then those of the lanes.
    lanes = rows.select("fold", "label", "stats").mapInArrow(sums, part).repartition("fold", "lane").mapInArrow(add, part)
    normal = np.zeros((FOLDS, size, size + 1))
    for k, _, data in lanes.repartition(FOLDS, "fold").mapInArrow(add, part).collect():  # a matrix of fixed size per fold
        normal[k] += np.frombuffer(data, np.float64).reshape(size, size + 1)

    def solve(m: np.ndarray) -> np.ndarray:
        penalty = ridge * max(m[-1, -2], 1.0) * np.eye(size)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(m[:, :-1] + penalty, m[:, -1])

    whole = normal.sum(axis=0)
    others = np.stack([solve(whole - normal[k]) for k in range(FOLDS)])
    binned = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("label", T.DoubleType())])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, z = np.asarray(batch.column(0)), start.expand(_matrix(batch.column(2)))
            raw = np.einsum("ij,ij->i", z, others[fold])
            at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=binned.names)

    table = rows.select("fold", "label", "stats").mapInArrow(bins, binned).groupBy("bin").agg(F.sum("label"), F.count("*")).collect()
    table = np.array(sorted((b, y, n) for b, y, n in table), float)  # one row per bin at most
    points, values = isotonic((table[:, 0] + 0.5) / BINS * 2 - 0.5, table[:, 1], table[:, 2])
    return Model(start.mean, start.scale, directions, phases, solve(whole), points, values)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score per row of `stats`."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=schema.names)

    return stats.select("doc_id", "stats").mapInArrow(run, schema)


def score_text(text: Column, model: Model) -> Column:
    """The score of a text column, for filters over whole rows."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)))

    return score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


def score_documents(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are not used."""
    stats = document_statistics(documents)
    model = fit(stats, labels.where(~held_out(F.col("doc_id"))))
    scored = score_statistics(stats, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    ), model
