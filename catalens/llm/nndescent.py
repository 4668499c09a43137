"""Approximate nearest neighbours by cosine: NN-descent, then greedy graph search.

Equal vectors are one point with its smallest ids, so a vector that many rows hold is
one node of the graph and ties go by id. The index:

1. Start. TREES codes of signs against random directions put the points into leaves of
   about LEAF points (larger ones are split by a hash); inside a leaf each point takes
   its NEIGHBOURS nearest.
2. Descent. Round by round the neighbours and reverse neighbours of every point meet in
   a group, with their vectors in half precision. Each learns of nearer ones among them;
   pairs that met before are left out. A group of more than GROUP is split by a hash that
   changes with the round. It ends when a round changes less than `stop` of all
   neighbours; as lists only get nearer, some round does.

A query starts at its nearest pivots (a sample of PIVOTS points, the only thing that is
broadcast) and, where its vector is in the index, at its own node. In each step it opens
its nearest unopened points, joins those neighbours that it has not met, and keeps the
nearest ones, as many as `beam_of` gives for the size of the index; it ends when all of
these are open. Scores are computed in double precision from the original vectors.

Every row with a vector is indexed. Vectors that are null, zero, or hold null or
non-finite components take no part, nor do those whose length is not the most common
one (ties: the longer). With few vectors a leaf holds them all and the result is exact.
Repeated ids are rows of their own, and a query never finds rows with its own id. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import discard, materialise, whole_groups
from catalens.sources.files import shuffles_removed

TREES, LEAF, NEIGHBOURS, GROUP, PIVOTS = 4, 256, 32, 128, 256
BEAM, OPEN, OFFERED = 160, 80, 10
SEED = 20240311


@dataclass(frozen=True)
class Index:
    points: DataFrame  # point, vector (bytes of float32), ids (the smallest `kept` ones)
    graph: DataFrame  # a row of BLOCK per bucket of points
    size: int
    dimension: int
    buckets: int


def valid(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col(column).cast("array<float>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def units(column: pa.Array, dtype=np.float32) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype)


def _packed(rows: DataFrame, schema: T.StructType, at: int) -> DataFrame:
    """The list of floats in column `at` as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            n = batch.num_rows
            flat = np.asarray(columns[at].flatten(), np.float32).reshape(n, -1) if n else np.empty((0, 1))
            columns[at] = pa.array([x.tobytes() for x in flat], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def points_of(rows: DataFrame, kept: int) -> DataFrame:
    """The distinct vectors, each with its `kept` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= kept)  # pruned before the shuffle
    grouped = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    schema = T.StructType([
        T.StructField("point", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType())),
    ])
    grouped = grouped.select(F.monotonically_increasing_id().alias("point"), F.col("v").alias("vector"), "ids")
    return _stored(_packed(grouped, schema, 1))


#: Points, and queries, to a bucket on the average; pairs that are measured at once.
POINTS, QUERIES, AT_ONCE = 2048, 512, 1 << 18
#: What lies in one bucket, all columns of a kind as bytes. The last column, of the rows that are stored, is a count.
BLOCK = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.ArrayType(T.BinaryType())),
    T.StructField("n", T.LongType()),
])
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.list_(pa.binary())), ("n", pa.int64())])
_Kinds = dict[int, list]  # of each kind the types of its columns
_Task = Callable[[int, dict[int, list[np.ndarray]]], Iterator[pa.RecordBatch]]


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """By hash, so that points and groups of any numbers are dealt evenly."""
    x = ids.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(buckets)).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def _whole(bucket: int, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    return _batch([(bucket, 0, [c.tobytes() for c in columns], n)])


def _deal(kind: int, to: np.ndarray, columns: list[np.ndarray], who: np.ndarray | None = None, about: list[np.ndarray] = []) -> pa.RecordBatch:
    """A block for every bucket that `to` names for the rows of `columns`.

    `who` is each row's place in `about`, whose rows go to a bucket once. Such blocks end
    with the columns of `about` and the number of rows that each of its rows has.
    """
    order = np.argsort(to, kind="stable") if who is None else np.argsort(to.astype(np.int64) << 32 | who)
    to, columns = to[order], [c[order] for c in columns]
    if who is not None:
        who = who[order]
        first = np.ones(len(to), bool)
        first[1:] = (to[1:] != to[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(first)
        counts = np.diff(np.append(first, len(to))).astype(np.int32)
        about = [*[c[who[first]] for c in about], counts]
    rows = []
    for a, b in _groups(to) if len(to) else []:
        data = [c[a:b].tobytes() for c in columns]
        if who is not None:
            low, high = np.searchsorted(first, [a, b])
            data += [c[low:high].tobytes() for c in about]
        rows.append((int(to[a]), kind, data, None))
    return _batch(rows)


def _in_place(rows: DataFrame, kinds: _Kinds, task: _Task) -> DataFrame:
    """`task` gets the columns of each kind in a bucket, whose blocks lie in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.setdefault(bucket, {}).setdefault(kind, []).append(data)
        for bucket in sorted(held):
            found = held.pop(bucket)
            columns = {}
            for kind, types in kinds.items():
                blocks, columns[kind] = found.pop(kind, []), []
                for k, (type_, width) in enumerate(types):
                    flat = np.frombuffer(b"".join([x[k] for x in blocks]), type_)
                    columns[kind].append(flat.reshape(-1, width) if width else flat)
            yield from task(bucket, columns)

    return rows.mapInArrow(run, BLOCK)


def _at_buckets(rows: list[DataFrame], buckets: int, kinds: _Kinds, task: _Task) -> DataFrame:
    """The same after the blocks were dealt to their buckets."""
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    return _in_place(both.repartitionById(buckets, F.col("bucket")), kinds, task)


def _only(rows: DataFrame, *columns: int) -> DataFrame:
    """Blocks with these columns."""
    return rows.withColumn("data", F.array(*[F.get("data", F.lit(c)) for c in columns]))


def _stored(rows: DataFrame) -> DataFrame:
    """The rows, written; what that shuffled goes from the executors' disks with its end."""
    with shuffles_removed(rows.sparkSession):
        return materialise(rows)


def _groups(*columns: np.ndarray) -> list[tuple[int, int]]:
    change = np.zeros(len(columns[0]) + 1, bool)
    change[0] = change[-1] = True
    for c in columns:
        change[1:-1] |= c[1:] != c[:-1]
    bounds = np.flatnonzero(change).tolist()
    return list(zip(bounds, bounds[1:]))


def _graph_types(dimension: int) -> list:
    """point, half, near (-1: none), sims, fresh; points in order."""
    return [(np.int64, 0), (np.float16, dimension), (np.int64, NEIGHBOURS), (np.float32, NEIGHBOURS), (np.bool_, NEIGHBOURS)]


_OFFER = [(np.int64, 0), (np.int64, 0), (np.float32, 0)]  # point, other, sim


def _best(sims: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `most` largest allowed entries of each row."""
    s = np.where(allowed, sims, -np.inf)
    if s.shape[1] > most:
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
    else:
        top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    row = np.repeat(np.arange(len(s)), top.shape[1])
    top = top.reshape(-1)
    good = np.isfinite(s[row, top])
    return row[good], top[good]


def _offer(point: np.ndarray, other: np.ndarray, sim: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _deal(1, bucket_of(point, buckets), [point, other, sim.astype(np.float32)])


def _start(points: DataFrame, size: int, dimension: int, buckets: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, size) / LEAF))))
    directions = np.random.RandomState(SEED).normal(size=(TREES, dimension, bits))
    schema = T.StructType([
        T.StructField("leaf", T.LongType()), T.StructField("point", T.LongType()), T.StructField("half", T.BinaryType()),
    ])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(1))
                half = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                for t in range(TREES if bits else 1):
                    signs = (x @ directions[t] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signs * TREES + t), batch.column(0), half], names=schema.names)

    coded = materialise(points.select("point", "vector").mapInArrow(code, schema))
    counts = coded.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("parts"))
    leaves = coded.join(counts, "leaf").withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            leaf, chunk, point = (np.asarray(table.column(k).combine_chunks()) for k in range(3))
            x, out = _halves(table.column(3)), []
            for a, b in _groups(leaf, chunk):
                sims = x[a:b] @ x[a:b].T
                row, top = _best(sims, ~np.eye(b - a, dtype=bool), NEIGHBOURS)
                out.append((point[a:b][row], point[a:b][top], sims[row, top]))
            yield _offer(*(np.concatenate([o[k] for o in out]) for k in range(3)), buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                point, half = np.asarray(batch.column(0)), units(batch.column(1), np.float16)
                none = [np.full((len(point), NEIGHBOURS), x, t) for x, (t, _) in zip((-1, -np.inf, False), _graph_types(dimension)[2:])]
                yield _deal(0, bucket_of(point, buckets), [point, half, *none])

    dealt = leaves.select("leaf", "chunk", "point", "half").repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk")
    graph = _merge(points.select("point", "vector").mapInArrow(place, BLOCK), dealt.mapInArrow(join, BLOCK), dimension, buckets)
    discard(coded)
    return graph


def _halves(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _ranked(row: np.ndarray, other: np.ndarray, sim: np.ndarray, flag: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """row, its place in the row's list, other, sim, flag of the `width` nearest others of each
    row. Of copies the one whose flag is lower stays."""
    _, rank = np.unique(other, return_inverse=True)
    key = (row.astype(np.int64) * (len(rank) + 1) + rank) * 2 + flag
    order = np.argsort(key)  # one key sorts several times faster than three
    key = key[order] >> 1
    once = np.ones(len(key), bool)
    once[1:] = key[1:] != key[:-1]
    order = order[once]
    row, other, sim, flag = row[order], other[order], sim[order], flag[order]
    bits = (-sim).view(np.uint32)
    falling = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)  # in the order of -sim
    order = np.argsort(row.astype(np.int64) << 32 | falling, kind="stable")  # ties by `other`
    row, other, sim, flag = row[order], other[order], sim[order], flag[order]
    at = np.arange(len(row))
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    keep = place < width
    return row[keep], place[keep], other[keep], sim[keep], flag[keep]


def _merge(graph: DataFrame, offers: DataFrame, dimension: int, buckets: int) -> DataFrame:
    """The nearest NEIGHBOURS of old and offered ones; those that are new are fresh and counted."""
    def task(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, half, near, sims, _ = columns[0]
        order = np.argsort(points)
        points, half, near, sims = points[order], half[order], near[order], sims[order]
        point, offered, sim = columns[1]
        at = np.searchsorted(points, point)
        old, column = np.nonzero(near >= 0)
        fresh = np.arange(len(old) + len(at)) >= len(old)  # known ones are kept: an offer of them is no news
        other = np.concatenate([near[old, column], offered])
        row = np.concatenate([old, at])
        itself = points[row] == other
        row, other, sim, fresh = row[~itself], other[~itself], np.concatenate([sims[old, column], sim])[~itself], fresh[~itself]
        row, place, other, sim, fresh = _ranked(row, other, sim, fresh, NEIGHBOURS)
        lists = [np.full(near.shape, x, t) for x, (t, _) in zip((-1, -np.inf, False), _graph_types(dimension)[2:])]
        for held, values in zip(lists, (other, sim, fresh)):
            held[row, place] = values
        yield _whole(bucket, [points, half, *lists], int(fresh.sum()))

    return _stored(_at_buckets([graph, offers], buckets, {0: _graph_types(dimension), 1: _OFFER}, task))


def _descend(graph: DataFrame, number: int, dimension: int, buckets: int) -> DataFrame:
    """One round: who is near to whom among the neighbours of each point.

    A point learns how many name it, as larger groups are split (kinds 1 and 2: named, by the
    bucket); then the two ends of each edge learn of each other's group (kind 1) and its
    size (kind 2), and each sends its vector to both.
    """
    state = _graph_types(dimension)

    def name(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        others, n = np.unique(columns[0][2][columns[0][2] >= 0], return_counts=True)
        yield _deal(1, bucket_of(others, buckets), [others, n.astype(np.int32), np.full(len(others), bucket, np.int32)])

    def tell(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, near, fresh = columns[0]
        named, n, by = columns[1]
        at = np.searchsorted(points, named)
        total = np.bincount(at, n, len(points)).astype(np.int32)
        row, column = np.nonzero(near >= 0)
        other = near[row, column]
        yield _deal(1, bucket_of(other, buckets), [other, points[row], fresh[row, column], total[row]])
        large = total[at] > GROUP
        yield _deal(2, by[large], [named[large], total[at[large]]])

    def send(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, half, near, sims, fresh = columns[0]
        own, centres, is_fresh, sizes = columns[1]
        large, large_sizes = columns[2]
        row, column = np.nonzero(near >= 0)
        other = near[row, column]
        order = np.argsort(large)
        large, large_sizes = np.append(large[order], -1), np.append(large_sizes[order], 0)
        place = np.searchsorted(large[:-1], other)
        who = np.concatenate([np.searchsorted(points, own), row])
        centre, new = np.concatenate([centres, other]), np.concatenate([is_fresh, fresh[row, column]])
        size = np.concatenate([sizes, np.where(large[place] == other, large_sizes[place], 0)])
        salt = bucket_of(points ^ (number + 1 << 40), 1 << 30)[who]
        chunk = np.where(size > GROUP, salt % (-(-size // GROUP) + 1), 0).astype(np.int32)
        worst = np.where(near[:, -1] >= 0, sims[:, -1], np.float32(-2))
        group = centre ^ (chunk.astype(np.int64) << 44)
        yield _deal(1, bucket_of(group, buckets), [centre, chunk, new], who, [points, worst, half])

    def meet(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        centre, chunk, new, points, worst, half, n = columns[1]
        who = np.repeat(np.arange(len(points)), n)
        order = np.lexsort((who, chunk, centre))
        centre, chunk, who, new = centre[order], chunk[order], who[order], new[order]
        first = np.ones(len(who), bool)  # neighbours both ways come twice
        first[1:] = (centre[1:] != centre[:-1]) | (chunk[1:] != chunk[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(first)
        if not len(first):
            return
        centre, chunk, who, new = centre[first], chunk[first], who[first], np.logical_or.reduceat(new, first)
        bounds = np.array(_groups(centre, chunk))
        sizes = np.diff(bounds, axis=1)[:, 0]
        wanted = np.flatnonzero(np.logical_or.reduceat(new, bounds[:, 0]) & (sizes > 1))
        wanted = wanted[np.argsort(sizes[wanted], kind="stable")]
        while len(wanted):
            count = min(len(wanted), max(1, AT_ONCE // int(sizes[wanted[0]]) ** 2))
            while count > 1 and count * int(sizes[wanted[count - 1]]) ** 2 > AT_ONCE:
                count -= max(1, count // 8)
            now, wanted = wanted[:count], wanted[count:]
            width = np.arange(sizes[now[-1]])
            there = width < sizes[now][:, None]
            at = np.where(there, bounds[now, :1] + width, bounds[now, :1])
            member, is_new = who[at], new[at] & there
            x = half[member].astype(np.float32)
            sims = x @ x.transpose(0, 2, 1)
            floor = np.where(there, worst[member], np.float32(np.inf))
            allowed = (sims > floor[:, :, None]) & (is_new[:, :, None] | is_new[:, None, :]) & there[:, None, :]
            allowed[:, width, width] = False
            allowed, sims = allowed.reshape(-1, len(width)), sims.reshape(-1, len(width))
            many = np.flatnonzero(np.count_nonzero(allowed, axis=1) > OFFERED)
            if len(many):
                row, column = _best(sims[many], allowed[many], OFFERED)
                allowed[many] = False
                allowed[many[row], column] = True
            row, column = np.nonzero(allowed)
            a, b = member.reshape(-1)[row], member[row // len(width), column]
            yield _offer(points[a], points[b], sims[row, column], buckets)

    named = _in_place(graph, {0: state}, name)
    told = _at_buckets([_only(graph, 0, 2, 4), named], buckets, {0: [state[0], state[2], state[4]], 1: [(np.int64, 0), (np.int32, 0), (np.int32, 0)]}, tell)
    edges = {0: state, 1: [(np.int64, 0), (np.int64, 0), (np.bool_, 0), (np.int32, 0)], 2: [(np.int64, 0), (np.int32, 0)]}
    sent = _at_buckets([graph, told], buckets, edges, send)
    members = [(np.int64, 0), (np.int32, 0), (np.bool_, 0), (np.int64, 0), (np.float32, 0), (np.float16, dimension), (np.int32, 0)]
    return _merge(graph, _at_buckets([sent], buckets, {1: members}, meet), dimension, buckets)


def beam_of(size: int) -> int:
    """Points that a search keeps: BEAM up to 10,000 points, and more for every doubling, as
    the same beam finds fewer of the nearest in a larger graph."""
    return BEAM + int(80 * max(0.0, np.log2(max(1, size) / 10_000)))


def build(embeddings: DataFrame, kept: int = 6, stop: float = 0.03) -> Index:
    """Index all vectors of `embeddings` (vec_id, embedding)."""
    points = points_of(valid(embeddings), kept)
    size = points.count()
    first = points.select("vector").first()
    dimension = len(first[0]) // 4 if first else 1
    buckets = max(1, -(-size // POINTS))
    graph = _start(points, size, dimension, buckets)
    for number in count() if size > 2 * LEAF else ():
        before, graph = graph, _descend(graph, number, dimension, buckets)
        discard(before)
        if (graph.agg(F.sum("n")).first()[0] or 0) <= stop * NEIGHBOURS * size:
            break
    return Index(points, graph, size, dimension, buckets)


def _unit(data: bytes) -> np.ndarray:
    return units(pa.array([data], pa.binary()))[0]


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, vector, point: each query's nearest points, enough for its `k` nearest ids.

    `queries`: query, vector (bytes of float32), own (its point in the index, or null); they
    are read twice.
    """
    pivots = index.points.orderBy(F.xxhash64("point", F.lit(SEED))).limit(PIVOTS).select("point", "vector").collect()
    if not pivots:
        return queries.select("query", "vector", F.lit(0).cast("long").alias("point")).limit(0)
    pivot_ids = np.array([p[0] for p in pivots])
    pivot_units = np.stack([_unit(p[1]) for p in pivots])
    width, dimension, buckets = beam_of(index.size), index.dimension, index.buckets
    homes = max(1, -(-queries.count() // QUERIES))
    # query, vector, beam (-1: none), sims, opened; the nearest first
    types = [(np.int64, 0), (np.float32, dimension), (np.int64, width), (np.float32, width), (np.bool_, width)]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            query, vector = np.asarray(batch.column(0)), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dimension)
            state = [np.full((len(query), width), x, t) for x, (t, _) in zip((-1, -np.inf, True), types[2:])]
            for row, (unit, own) in enumerate(zip(units(batch.column(1)), batch.column(2).to_pylist())):
                sims = pivot_units @ unit
                top = np.argsort(-sims, kind="stable")[:OPEN]
                beam, near = pivot_ids[top].tolist(), sims[top].tolist()
                if own is not None:
                    if own in beam:
                        near.pop(beam.index(own))
                        beam.remove(own)
                    beam, near = [own, *beam], [1.0, *near]
                for held, values in zip(state, (beam, near, False)):
                    held[row, : len(beam)] = values
            yield _deal(0, bucket_of(query, homes), [query, vector, *state])

    def begin(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """One block of a bucket's queries in order; n counts those that have points to open."""
        order = np.argsort(columns[0][0])
        yield _whole(bucket, [c[order] for c in columns[0]], len(order))

    def settle(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        query, vector, beam, sims, opened = columns[0]
        opened = opened | ((~opened).cumsum(axis=1) <= OPEN)
        asked, point, sim = columns[1]
        old, column = np.nonzero(beam >= 0)
        shut = np.concatenate([~opened[old, column], np.ones(len(point), bool)])
        row = np.concatenate([old, np.searchsorted(query, asked)])
        other, sim = np.concatenate([beam[old, column], point]), np.concatenate([sims[old, column], sim])
        row, place, *values = _ranked(row, other, sim, shut, width)
        state = [np.full(beam.shape, x, t) for x, (t, _) in zip((-1, -np.inf, True), types[2:])]
        for held, x in zip(state, (values[0], values[1], ~values[2])):
            held[row, place] = x
        yield _whole(bucket, [query, vector, *state], int((~state[2]).any(axis=1).sum()))

    def choose(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        query, _, beam, _, opened = columns[0]
        row, column = np.nonzero(~opened & ((~opened).cumsum(axis=1) <= OPEN))
        point = beam[row, column]
        yield _deal(1, bucket_of(point, buckets), [point, query[row]])

    def open_(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, near = columns[0]
        point, query = columns[1]
        at = np.searchsorted(points, point)
        for a in range(0, len(at), 1 << 16):
            row, column = np.nonzero(near[at[a : a + (1 << 16)]] >= 0)
            asked, other = query[a + row], near[at[a + row], column]
            yield _deal(1, bucket_of(asked, homes), [asked, other])

    def ask(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """For the vectors of points that a query has not in its beam."""
        query, vector, beam, sims, _ = columns[0]
        asked, point = columns[1]
        row = np.searchsorted(query, asked)
        order = np.lexsort((point, row))
        row, point = row[order], point[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (point[1:] != point[:-1])
        row, point = row[once], point[once]
        known = np.zeros(len(row), bool)
        for a, b in _groups(row) if len(row) else []:
            known[a:b] = np.isin(point[a:b], beam[row[a]])
        row, point = row[~known], point[~known]
        x = vector.astype(np.float64) / np.abs(vector).max(axis=1, keepdims=True)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        yield _deal(1, bucket_of(point, buckets), [point], row, [query, unit, sims[:, -1]])

    def measure(bucket: int, columns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        points, half = columns[0]
        point, query, unit, floor, n = columns[1]
        who, at, half = np.repeat(np.arange(len(query)), n), np.searchsorted(points, point), half.astype(np.float32)
        for a in range(0, len(at), 1 << 16):
            w, p = who[a : a + (1 << 16)], at[a : a + (1 << 16)]
            sims = (half[p] * unit[w]).sum(axis=1)  # the same for a pair in every step, unlike a product of matrices
            near = sims >= floor[w]
            w, p, sims = w[near], p[near], sims[near]
            yield _deal(1, bucket_of(query[w], homes), [query[w], points[p], sims])

    graph, pair = _graph_types(dimension), [(np.int64, 0), (np.int64, 0)]
    met = [(np.int64, 0), (np.int64, 0), (np.float32, dimension), (np.float32, 0), (np.int32, 0)]
    state = _stored(_at_buckets([queries.select("query", "vector", "own").mapInArrow(enter, BLOCK)], homes, {0: types}, begin))
    while state.agg(F.sum("n")).first()[0]:  # every step opens points of all active queries, and none twice
        chosen = _in_place(state.where("n > 0"), {0: types}, choose)
        opened = _at_buckets([_only(index.graph, 0, 2), chosen], buckets, {0: [graph[0], graph[2]], 1: pair}, open_)
        asked = _at_buckets([state, opened], homes, {0: types, 1: pair}, ask)
        found = _at_buckets([_only(index.graph, 0, 1), asked], buckets, {0: graph[:2], 1: met}, measure)
        before, state = state, _stored(_at_buckets([state, found], homes, {0: types, 1: _OFFER}, settle))
        discard(before)
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("point", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                query, beam = np.frombuffer(data[0], np.int64), np.frombuffer(data[2], np.int64).reshape(-1, width)
                beam = beam[:, : k + 16]  # more than k, for near ties in single precision
                row, column = np.nonzero(beam >= 0)
                vectors = pa.array([v.tobytes() for v in np.frombuffer(data[1], np.float32).reshape(-1, dimension)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(query[row]), vectors.take(pa.array(row)), pa.array(beam[row, column])], names=schema.names)

    return state.mapInArrow(read, schema)


def nearest(index: Index, embeddings: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `embeddings` to each row of `wanted`,
    its own id left out. `index` keeps at least k + 1 ids per point."""
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vector", T.BinaryType())])
    rows = valid(wanted).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    rows = materialise(_packed(rows.where(F.size("vector") == index.dimension), schema, 2))
    own = index.points.select("vector", F.col("point").alias("own"))
    found = search(index, _stored(rows.join(own, "vector", "left").select("query", "vector", "own")), k)
    pairs = found.join(rows.select("query", "query_id"), "query").join(index.points.select("point", F.col("vector").alias("other"), "ids"), "point")
    out = T.StructType([
        T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) for c in ("vector", "other"))
            value = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            ids = batch.column("ids")
            each = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(ids.offsets)))
            take = pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(take), batch.column("query_id").take(take), ids.flatten(), pa.array(value[each])], names=out.names
            )

    scored = pairs.select("query", "query_id", "vector", "other", "ids").mapInArrow(score, out).where("vec_id <> query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
