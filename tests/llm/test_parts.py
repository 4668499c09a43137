"""The building blocks, against plain versions of themselves."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalens.llm import decontaminate, minhash, mixing, quality, shards, tokenfile, wordhash
from catalens.llm.components import components
from catalens.llm.store import running_total, whole_groups


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_packing(width, numbers):
    ids = np.array([n & ((1 << width) - 1) for n in numbers], np.uint32)
    data = tokenfile.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert tokenfile.unpack(data, len(ids), width).tolist() == ids.tolist()


def test_token_file_random_access(tmp_path):
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "f")
    ids = np.random.RandomState(0).randint(0, 50257, 200_000).astype(np.uint32)
    cuts = [0, 5, 5, 70_000, 199_999, 200_000]
    writer = tokenfile.Writer(store, path, 16)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        writer.add(None if i == 1 else i, ids[a:b])
    assert writer.close() == store.get_file_info(path).size
    reader = tokenfile.Reader(store, path)
    assert reader.docs.to_pylist() == [0, None, 2, 3, 4]
    assert all((reader.document(i) == ids[a:b]).all() for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert (reader.read(65_000, 140_000) == ids[65_000:140_000]).all()


@given(st.lists(st.text(alphabet="ab Z\t\né", max_size=40), max_size=8), st.integers(3, 50))
@settings(max_examples=80, deadline=None)
def test_word_hashes(texts, size):
    old, wordhash.SLICE = wordhash.SLICE, size
    try:
        hashes, firsts = wordhash.word_hashes(pa.array(texts, pa.string()).slice(0))
    finally:
        wordhash.SLICE = old
    words = [[re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())] for t in texts]
    assert np.diff(firsts).tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(flat)) == len(set(zip(flat, hashes.tolist()))) == len(set(hashes.tolist()))


def test_components(spark):
    rng = random.Random(3)
    paths = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5000, i) for i in range(6000, 6400)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    links = [*paths, *star, *loose, *paths[:5]]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found.keys() == linked
    assert len({(root(x), found[x]) for x in linked}) == len({root(x) for x in linked}) == len(set(found.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_groups_are_split_and_stay_exact(spark, monkeypatch):
    for name, value in (("CHUNK", 16), ("PART", 8), ("HUBS", 2)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 5
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    from tests.llm.test_queries import brute_components

    expected = brute_components(dict(enumerate(texts)), 2, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.near_duplicates(docs, shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert 3 < len({c for _, c in expected.values()}) < 100


def test_pairs_of_a_split_group_meet_without_hubs(spark, monkeypatch):
    """Pages of a template, too far from each other for hubs, that hold near pairs."""
    for name, value in (("CHUNK", 8), ("PART", 4), ("HUBS", 2)):
        monkeypatch.setattr(minhash, name, value)
    # One band hash for all nodes, and another for all: no second chance in a small group.
    hashes = minhash.band_hashes
    monkeypatch.setattr(minhash, "band_hashes", lambda m: np.arange(2, dtype=np.int64) + 0 * hashes(m)[:2])
    rng, texts = random.Random(6), []
    template = [f"t{i}" for i in range(40)]
    for page in range(60):
        own = template + [f"p{page}x{i}" for i in range(40)]
        texts.append(" ".join(own))
        if page % 2:
            own[-rng.randrange(1, 4)] = f"q{page}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tests.llm.test_queries import brute_components

    expected = brute_components(dict(enumerate(texts)), 2, 80)
    assert len({c for _, c in expected.values()}) == 60
    rows = minhash.near_duplicates(docs, shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: c for d, (_, c) in expected.items()}


def test_estimated_similarity():
    rng = np.random.RandomState(1)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(30):
            own = rng.randint(0, 2**63, 400).astype(np.uint64)
            other = own.copy()
            other[: int(400 * (1 - share))] = rng.randint(0, 2**63, int(400 * (1 - share))).astype(np.uint64)
            exact = len(np.intersect1d(own, other)) / len(np.union1d(own, other))
            packed = [np.frombuffer(minhash.low_bits(minhash.minima(x)), np.uint32).reshape(2, -1) for x in (own, other)]
            errors.append(float(minhash.similarity(*packed)) - exact)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


@pytest.mark.parametrize("common", [4, 8, 16])
def test_no_pair_of_small_sets_is_estimated_away(common):
    """Pairs at exactly 0.8: chance matches of two bits must be independent of each other."""
    rng = np.random.RandomState(common)
    for _ in range(10_000):
        own = rng.randint(0, 2**63, common + common // 4).astype(np.uint64)
        packed = [np.frombuffer(minhash.low_bits(minhash.minima(x)), np.uint32).reshape(2, -1) for x in (own, own[:common])]
        assert minhash.similarity(*packed) >= minhash.near(80)


def plain_alignment(item, words):
    best = 0.0
    table = [[0.0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            match = 1.0 if x == y else -decontaminate.COST
            table[i][j] = max(0.0, table[i - 1][j - 1] + match, table[i - 1][j] - decontaminate.COST, table[i][j - 1] - decontaminate.COST)
            best = max(best, table[i][j])
    return best


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=150, deadline=None)
def test_alignment(item, words):
    score, first, end = decontaminate.align(np.array(item, np.uint64), np.array(words, np.uint64))
    assert score == pytest.approx(plain_alignment(item, words))
    assert plain_alignment(item, words[first:end]) == pytest.approx(score)


def test_isotonic():
    points, values = quality.isotonic(np.arange(6.0), np.array([1.0, 0, 3, 2, 2, 4]), np.array([2.0, 2, 4, 2, 2, 4]))
    assert values.tolist() == [0.25, 0.75, 1.0] or np.allclose(values, [0.25, 0.75, 1.0, 1.0, 1.0])
    assert (np.diff(values) >= 0).all() and (np.diff(points) > 0).all()


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12_345])
def test_apportionment(spark, seats):
    import heapq

    rng = random.Random(seats)
    votes = {f"s{i}": float(rng.choice([0, 1, 10, 10, 333, 9_999])) for i in range(25)}
    limits = {s: rng.choice([0, 3, 10_000]) for s in votes}
    frame = spark.createDataFrame([(s, v, limits[s]) for s, v in votes.items()], "source string, v double, lim long")
    found = {r["source"]: r["quota"] for r in mixing.apportion(frame, seats, "v", "lim").collect()}
    won = dict.fromkeys(votes, 0)
    heap = [(-v, s) for s, v in votes.items() if v and limits[s]]
    heapq.heapify(heap)
    for _ in range(min(seats, sum(limits.values()))):
        if not heap:
            break
        _, s = heapq.heappop(heap)
        won[s] += 1
        if won[s] < limits[s]:
            heapq.heappush(heap, (-votes[s] / (2 * won[s] + 1), s))
    assert sum(found.values()) == sum(won.values())
    # Ties between equal quotients may go to another source of the same votes.
    by_votes = lambda x: sorted((votes[s], limits[s], n) for s, n in x.items())
    assert by_votes(found) == by_votes(won)


def test_shard_quotas(spark):
    plan = spark.createDataFrame([("a", 30, 0, 17), ("b", 5, 2, 4), (None, 0, 0, 0)], "source string, blocks long, rounds long, chosen long")
    rows = mixing.shard_quotas(plan, 4).collect()
    for source, blocks, rounds, chosen in (("a", 30, 0, 17), ("b", 5, 2, 4), (None, 0, 0, 0)):
        own = [r["blocks"] for r in sorted(rows, key=lambda r: r["shard"]) if r["source"] == source]
        held = [len(range(shard, blocks, 4)) for shard in range(4)]
        assert len(own) == 4 and sum(own) == rounds * blocks + chosen
        assert all(rounds * h <= n <= (rounds + 1) * h for n, h in zip(own, held))
        more = [n - rounds * h for n, h in zip(own, held)]
        assert max(more) - min(more) <= 1


def test_rebalancing():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(512)]
    first = shards.first_map(sizes, 8)
    load = lambda m, sizes: [sum(s for s, o in zip(sizes, m.owner) if o == k) for k in range(m.shards)]
    assert max(load(first, sizes)) - min(load(first, sizes)) <= 100
    assert shards.rebalance(first, sizes).owner == first.owner
    grown = shards.rebalance(first, sizes, 9)
    assert grown.version == 2 and max(load(grown, sizes)) < 1.05 * sum(sizes) / 9
    assert sum(a != b for a, b in zip(first.owner, grown.owner)) < 512 / 5
    shrunk = shards.rebalance(grown, sizes, 5)
    assert set(shrunk.owner) == set(range(5)) and max(load(shrunk, sizes)) < 1.05 * sum(sizes) / 5


def test_map_versions(spark, tmp_path):
    first = shards.first_map(list(range(64)), 4)
    for m in (first, shards.rebalance(first, list(range(64)), 5)):
        shards.write_map(spark, m, f"file://{tmp_path}/map")
        assert shards.read_map(spark, f"file://{tmp_path}/map", m.version) == m


def test_running_total(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, v long").repartition(5)
    found = sorted((r["k"], r["v"], r["t"]) for r in running_total(frame, ["k", "v"], F.col("v"), "t").collect())
    total, expected = 0, []
    for k, v in sorted(rows):
        expected.append((k, v, total))
        total += v
    assert found == expected


def test_whole_groups():
    rng = random.Random(4)
    keys = sorted(rng.randrange(30) for _ in range(200))
    table = pa.table({"k": keys, "i": range(200)})
    for size in (1, 7, 1000):
        parts = list(whole_groups(iter(table.to_batches(max_chunksize=size)), 1))
        assert pa.concat_tables(parts).to_pydict() == table.to_pydict()
        seen = [set(p.column(0).to_pylist()) for p in parts]
        assert sum(map(len, seen)) == len(set(keys))
