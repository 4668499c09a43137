"""Near-duplicates by b-bit MinHash, confirmed on full sets.

A document's set has its distinct runs of `shingle` words (white space parts words, A-Z
is lower-cased); with fewer words it has the whole sequence as its one element, and
without words it is empty and linked with nothing. Documents are linked whose sets have
a Jaccard similarity of at least `percent` / 100. Equal sets are one node from the
start, so a group of copies, however large, costs what one document costs.

1. Signatures. BANDS * ROWS minima per set; the band hashes, and of every minimum, mixed,
   two bits, packed into words. A pair at 0.8 misses all bands once in 50,000.
2. Candidates. Nodes that share a band hash meet in groups of at most CHUNK: a larger
   group is split by a hash, and its most connected nodes go into every part. Inside a
   group the counts of equal bits, corrected for chance, estimate all similarities.
   Of the pairs over `near`, five standard errors under the threshold, only the
   components leave the task, as links of each node to the smallest one. In groups of
   several parts every node outside the group's largest component is then compared with
   all other nodes of the group, part by part. The components of all links are clusters.
3. Confirmation. The full sets of a cluster meet in parts of at most PART nodes, again
   with its most connected nodes in every part. Exact counts of common elements give
   the links; again only their components leave the task.
4. Rest. In clusters of several parts every node outside the largest confirmed group is
   compared with all other nodes of its cluster, part by part.

So all pairs of a cluster are decided exactly without any of them being emitted, and
step 4 works on (nodes not yet linked) x (cluster) only.

Repeated rows are documents of their own with equal sets. Documents with a null id take
part and get the smallest id of their group, or null where it has none. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.components import components
from catalens.llm.store import materialise, whole_groups
from catalens.llm.wordhash import gram_hashes, mix, slices, word_hashes

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 36, 6
MINIMA = BANDS * ROWS
CHUNK, PART, HUBS = 1024, 512, 16
_WORDS = -(-MINIMA // 32)  # 32-bit words per plane of bits

_random = np.random.RandomState(20240229)
_A = _random.randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_MIX = _random.randint(0, 1 << 32, (2, ROWS), dtype=np.uint64) | np.uint64(1)


def near(percent: int) -> float:
    """Five standard errors under the threshold, for two bits of each minimum."""
    s = percent / 100
    match = 0.25 + 0.75 * s
    return s - 5 * np.sqrt(match * (1 - match) / MINIMA) / 0.75


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word runs."""
    words, firsts = word_hashes(texts)
    grams, out = gram_hashes(words, n), []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:  # marked by its length, so that it equals no longer run
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(own: np.ndarray) -> bytes:
    """128 bits of a set."""
    a, b = mix(own), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([a.sum(dtype=np.uint64), np.bitwise_xor.reduce(b) + np.uint64(len(own))], "<u8").tobytes()


def minima(own: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(17)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (low[at : at + 2048, None] * _A + _B).min(axis=0))
    return best


def band_hashes(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    return (mix((rows * _MIX[0]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def low_bits(m: np.ndarray) -> bytes:
    """Two bits of each minimum, mixed first: the low bits of low * A + B hang on low mod 4 alone."""
    m = (m ^ (m >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    m = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    padded = np.zeros(_WORDS * 32, np.uint32)
    padded[:MINIMA] = m ^ (m >> np.uint32(16))
    return np.packbits([padded & 1, padded >> 1 & 1], axis=1).tobytes()


def planes(column: pa.Array) -> np.ndarray:
    """Packed signatures as (rows, 2, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), 2, _WORDS)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures, corrected for chance matches of two bits."""
    x = a ^ b
    differ = np.bitwise_count(x[..., 0, :] | x[..., 1, :]).sum(axis=-1)
    return ((MINIMA - differ) / MINIMA - 0.25) / 0.75


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_hash", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("bits", T.BinaryType()),
])


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(2), shingle)
                marks = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else band_hashes(m) for m in marks], pa.list_(pa.int64())),
                    pa.array([None if m is None else low_bits(m) for m in marks], pa.binary()),
                ], names=SIGNED.names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return materialise(rows.mapInArrow(run, SIGNED))


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pieces(linked: np.ndarray) -> np.ndarray:
    """The connected component of every row of a symmetric boolean matrix, as a number."""
    piece, count = np.full(len(linked), -1), 0
    while (piece < 0).any():
        queue = [int((piece < 0).argmax())]
        piece[queue[0]] = count
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & (piece < 0))
            piece[new] = count
            queue += new.tolist()
        count += 1
    return piece


def roots(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For every row the smallest node of its component."""
    piece = pieces(linked)
    least = np.full(piece.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, piece, node)
    return least[piece]


def _groups(*columns: np.ndarray) -> list[tuple[int, int]]:
    change = np.zeros(len(columns[0]) + 1, bool)
    change[0] = change[-1] = True
    for c in columns:
        change[1:-1] |= c[1:] != c[:-1]
    bounds = np.flatnonzero(change).tolist()
    return list(zip(bounds, bounds[1:]))


def _spread(rows: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """Adds `chunk` and `hub`: groups larger than `limit` in parts, their HUBS best connected
    nodes, marked, in each."""
    parts = F.ceil(F.col(size) / limit).cast("int")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("pop").desc(), "node"))
    hubs = rows.where(F.col(size) > limit).withColumn("_rank", rank).where(F.col("_rank") <= HUBS).drop("_rank")
    hubs = hubs.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
    salted = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int"))
    return salted.withColumn("hub", F.lit(False)).unionByName(hubs.withColumn("hub", F.lit(True)))


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes that share a band and look similar; and pop per node."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(shared, "key"))
    pop = materialise(members.groupBy("node").agg(F.sum("n").alias("pop")))
    marked = members.join(nodes.select("node", "n_shingles", "bits").join(pop, "node"), "node")
    spread = _spread(marked, "key", "n", CHUNK).select("key", "chunk", "node", "n_shingles", "bits")
    least = near(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            key, chunk, node, size = (np.asarray(table.column(k).combine_chunks()) for k in range(4))
            sign = planes(table.column(4).combine_chunks())
            groups = _groups(key, chunk)
            two = np.array([a for a, b in groups if b - a == 2], np.int64)
            out = []
            if len(two):
                good = (similarity(sign[two], sign[two + 1]) >= least) & (node[two] != node[two + 1])
                good &= np.minimum(size[two], size[two + 1]) * 100 >= percent * np.maximum(size[two], size[two + 1])
                out += list(zip(node[two[good]].tolist(), node[two[good] + 1].tolist()))
            for a, b in groups:
                if b - a > 2:
                    own, n = sign[a:b], size[a:b]
                    close = np.stack([similarity(own, own[i]) >= least for i in range(b - a)])
                    close &= np.minimum(n[:, None], n) * 100 >= percent * np.maximum(n[:, None], n)
                    out += list(zip(roots(close, node[a:b]).tolist(), node[a:b].tolist()))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_LINK_ARROW)

    dealt = spread.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    links = materialise(dealt.mapInArrow(run, LINK).distinct())
    large = members.where(F.col("n") > CHUNK)
    if large.take(1):
        links = links.unionByName(candidates_rest(large, nodes, links, percent))
    return links, pop


def _grid(rows: DataFrame, outer: str, limit: int, columns: list[str]) -> DataFrame:
    """Nodes outside the largest `group` of their `outer` group (side 0) and all its nodes
    (side 1), in cells (i, j) in which each of the former meets each of the latter once."""
    sizes = materialise(rows.groupBy(outer, "group").agg(F.count("*").alias("n")))
    largest = sizes.groupBy(outer).agg(
        F.max_by("group", F.struct("n", "group")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")
    )
    rows = rows.join(largest, outer).withColumn("rest", F.col("all") - F.col("most")).where("rest > 0")
    left_parts, right_parts = (F.ceil(F.col(c) / limit).cast("int") for c in ("rest", "all"))
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    salt = F.xxhash64("node")
    left = rows.where("group <> largest").withColumn("i", F.pmod(salt, left_parts).cast("int")).withColumn("j", every(right_parts))
    right = rows.withColumn("j", F.pmod(salt, right_parts).cast("int")).withColumn("i", every(left_parts))
    columns = [outer, "i", "j", "side", "node", "group", *columns]
    both = left.withColumn("side", F.lit(0)).select(columns).unionByName(right.withColumn("side", F.lit(1)).select(columns))
    return both.repartition(outer, "i", "j").sortWithinPartitions(outer, "i", "j", "side")


def candidates_rest(large: DataFrame, nodes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """In band groups of several parts: nodes outside the largest component against all others."""
    label = components(links).withColumnRenamed("component", "group")
    own = nodes.select("node", "n_shingles", "bits").join(label, "node", "left")
    own = own.withColumn("group", F.coalesce("group", "node"))
    rows = materialise(large.select("key", "node").join(own, "node"))
    least = near(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            key, i, j, side, _, group, size = (np.asarray(table.column(k).combine_chunks()) for k in range(7))
            sign = planes(table.column(7).combine_chunks())
            out = [np.empty((0, 2), np.int64)]
            for a, b in _groups(key, i, j):
                middle = a + int((side[a:b] == 0).sum())
                for x in range(a, middle):
                    close = (similarity(sign[middle:b], sign[x]) >= least) & (group[middle:b] != group[x])
                    close &= np.minimum(size[middle:b], size[x]) * 100 >= percent * np.maximum(size[middle:b], size[x])
                    if close.any():
                        other = np.unique(group[middle:b][close])
                        out.append(np.stack([np.full(len(other), group[x]), other], axis=1))  # of groups, not of nodes
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_LINK_ARROW)

    return materialise(_grid(rows, "key", CHUNK, ["n_shingles", "bits"]).mapInArrow(run, LINK).distinct())


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all left with all right sets."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(values), 4096):
        a, b = np.searchsorted(place, [at, at + 4096])
        dense = np.zeros((len(left) + len(right), 4096), np.float32)
        dense[row[a:b], place[a:b] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    both = common(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - both
    return both * 100 >= percent * union


def full_sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, cluster, members, pop, elements: the sets of the wanted nodes, from the texts anew."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    # By id and text: many rows may have one id, or none.
    same = F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_hash") == F.col("rep_text"))
    found = rows.join(wanted, same).select("cluster", "node", "members", "pop", "digest", "text")
    schema = T.StructType([
        T.StructField("cluster", T.LongType()), T.StructField("node", T.LongType()), T.StructField("members", T.LongType()),
        T.StructField("pop", T.LongType()), T.StructField("elements", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(5)):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(5), shingle)
                same = [len(s) > 0 and digest(s) == d for s, d in zip(sets, part.column(4).to_pylist())]
                kept = pa.array(same)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).filter(kept) for k in range(4)), pa.array([s.tobytes() for s, k in zip(sets, same) if k], pa.binary())],
                    names=schema.names,
                )

    # An id may stand on several rows: one of those with the right set is enough.
    return found.mapInArrow(run, schema)


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


GROUPED = T.StructType([
    T.StructField("cluster", T.LongType()), T.StructField("members", T.LongType()), T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType()), T.StructField("label", T.LongType()),
])


def confirm(sets: DataFrame, percent: int) -> DataFrame:
    """The exact components inside each part of a cluster.

    Per node b: the smallest node a of its component, and as label the smallest of the
    nodes that are in every part, where the component has one, else a. So nodes with one
    label are connected, whatever their parts.
    """
    spread = _spread(sets, "cluster", "members", PART).select("cluster", "chunk", "node", "members", "elements", "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            cluster, chunk, node, members = (np.asarray(table.column(k).combine_chunks()) for k in range(4))
            hub = np.asarray(table.column(5).combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
            least, label = np.empty_like(node), np.empty_like(node)
            for a, b in _groups(cluster, chunk):
                own = _arrays(table.column(4).slice(a, b - a))
                close = linked(own, own, percent)
                least[a:b] = label[a:b] = roots(close, node[a:b])
                if hub[a:b].any():
                    named = roots(close, np.where(hub[a:b], node[a:b], np.iinfo(np.int64).max))
                    label[a:b] = np.where(named < np.iinfo(np.int64).max, named, label[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, members, least, node, label)], names=GROUPED.names)

    dealt = spread.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk")
    return materialise(dealt.mapInArrow(run, GROUPED))


def confirm_rest(sets: DataFrame, confirmed: DataFrame, percent: int) -> DataFrame:
    """In clusters of several parts: nodes outside the largest group against all others."""
    label = confirmed.where(F.col("members") > PART).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("group"))
    rows = materialise(sets.where(F.col("members") > PART).join(label, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            cluster, i, j, side, node, group = (np.asarray(table.column(k).combine_chunks()) for k in range(6))
            out = set()
            for a, b in _groups(cluster, i, j):
                middle = a + int((side[a:b] == 0).sum())
                if a == middle or middle == b:
                    continue
                close = linked(_arrays(table.column(6).slice(a, middle - a)), _arrays(table.column(6).slice(middle, b - middle)), percent)
                close &= group[a:middle, None] != group[middle:b]
                x, y = np.nonzero(close)
                pairs = np.stack([group[a:middle][x], group[middle:b][y]], axis=1)
                out.update(map(tuple, np.unique(pairs, axis=0).tolist()))  # of groups, not of nodes
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_LINK_ARROW)

    return materialise(_grid(rows, "cluster", PART, ["elements"]).mapInArrow(run, LINK).distinct())


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, component_id, kept per row of `documents`."""
    signed = signatures(documents, shingle)
    first = F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "text_hash"))  # an id before none
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(
        first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    nodes = nodes.withColumns({"rep": F.col("first.doc_id"), "rep_text": F.col("first.text_hash")}).drop("first")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    links, pop = candidates(nodes, percent)
    clusters = components(links).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    wanted = clusters.join(sizes, "cluster").join(pop, "node").join(nodes.select("node", "rep", "rep_text", "digest"), "node")
    sets = full_sets(documents, wanted, shingle).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("cluster", "members", "pop", "elements")]
    )
    sets = materialise(sets)
    confirmed = confirm(sets, percent)
    links = confirmed.select("a", "b")
    if sets.where(F.col("members") > PART).take(1):
        links = links.unionByName(confirm_rest(sets, confirmed, percent))
    groups = components(links)
    group = F.coalesce("component", "node")
    own = nodes.select("digest", "node", "rep").join(groups, "node", "left").select("digest", "rep", group.alias("group"))
    own = materialise(own)
    lowest = materialise(own.groupBy("group").agg(F.min("rep").alias("component_id")))  # so that a large group's join is split
    table = own.join(lowest, "group").select("digest", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "digest")
        .join(table, "digest", "left")
        .withColumn("component_id", component)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `documents` that stay: of every group of near-duplicates the one with the
    smallest id, once. Documents without words all stay. Rows without an id stay once per
    distinct set unless a row with an id is near."""
    columns = documents.columns
    found = materialise(near_duplicates(documents, shingle, percent).where("kept"))  # large groups of copies stay split
    worded = found.where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.min("text_hash").alias("__text"))
    kept = worded.select(F.col("doc_id").alias("__id"), "__text").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.withColumn("__hash", F.xxhash64(text))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
    stay = keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__hash"])
    wordless = keyed.where(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "")
    return stay.unionByName(wordless).select(*[F.col(f"`{c}`") for c in columns])
