"""The dealt methods lie on the path of the queries: each test fails where one is left out."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalens.llm import decontaminate, mixing, nndescent, quality, shards, tokencount, tokenfile, warc
from catalens.llm import queries as bound
from catalens.llm.store import read_manifest, scratch
from catalens.llm.vocab import read_vocabulary
from catalens.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def recorded(monkeypatch):
    """Records what a function returned."""

    def record(module, name):
        calls, whole = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(whole(*a, **k)) or calls[-1])
        return calls

    return record


def test_shards_come_from_a_stored_map(spark, recorded):
    maps, written = recorded(shards, "read_map"), recorded(shards, "write_map")
    rows = bound.op4_shards(spark, SF).collect()
    assert len(maps) == len(written) == 1 and maps[0].version == 1
    assert all(r["shard"] == maps[0].owner[r["virtual_slot"]] for r in rows)


def test_token_counts_come_from_the_cache(spark, monkeypatch):
    seen, whole = [], tokencount.token_counts

    def counted(documents, vocabulary, cache):
        stored = {bytes(r["content"]): r["n_tokens"] for r in spark.read.parquet(cache).collect()}
        short = documents.where(F.octet_length("text") <= bound.SHORT_TEXT)
        assert stored and len(stored) == short.select("text").distinct().count()
        # A count that only the cache can hold.
        spark.createDataFrame([(content, n + 1_000_000) for content, n in stored.items()], "content binary, n_tokens long").withColumn(
            "tokenizer", F.lit(spark.read.parquet(cache).first()["tokenizer"])
        ).select("content", "tokenizer", "n_tokens").write.parquet(f"{cache}-marked")
        before = spark.read.parquet(f"{cache}-marked").count()
        result = whole(documents, vocabulary, f"{cache}-marked")
        seen.append((before, spark.read.parquet(f"{cache}-marked").count()))
        return result

    monkeypatch.setattr(tokencount, "token_counts", counted)
    rows = bound.op8_tokencount(spark, SF).collect()
    texts = {r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert seen == [(sum(len(t.encode()) <= bound.SHORT_TEXT for t in texts), len(texts))]  # only misses were added
    assert all((r["n_tokens"] >= 1_000_000) == (r["n_bytes"] <= bound.SHORT_TEXT) for r in rows)


@pytest.mark.parametrize("aim", [0.4, 1.0, 9.0])
def test_mixing_takes_each_shards_quota_of_blocks(spark, aim):
    """Documents of just one block each: what is taken of them is what blocks were given."""
    n, block = 500, mixing.BLOCK
    docs = spark.createDataFrame([(i, "a", block) for i in range(n)] + [(n + i, "b", block) for i in range(300)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", aim), ("b", 1.0)], "source string, weight double")
    mixed, planned = mixing.mix(docs, weights)
    plan = {r["source"]: r for r in planned.collect()}
    quotas = {(r["source"], r["shard"]): r["blocks"] for r in mixing.shard_quotas(planned).collect()}
    keyed = docs.withColumn("key", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), F.col("size"))).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    for source, count in (("a", n), ("b", 300)):
        own = sorted((r["key"], r["doc_id"]) for r in keyed if r["source"] == source)
        given = defaultdict(list)
        for place, (_, doc_id) in enumerate(own):
            given[place % mixing.SHARDS].append(taken[doc_id])
        p = plan[source]
        assert sum(map(sum, given.values())) == p["words"] and abs(p["words"] - p["target"]) < 2
        assert abs(p["words"] - p["quota"] * block) <= block
        for shard, values in given.items():
            assert sum(v // block for v in values) == quotas[source, shard]
            assert max(values) - min(values) <= block
        assert sum(v % block > 0 for vs in given.values() for v in vs) == (p["rest"] > 0)
        assert max(sum(vs) // len(vs) for vs in given.values()) - min(sum(vs) // len(vs) for vs in given.values()) <= 2 * block / 18


def test_quotas_decide_what_is_taken(spark, monkeypatch):
    """Words stay within a block of the quota, and a quota rounded up has its first chosen block cut."""
    block = mixing.BLOCK
    docs = spark.createDataFrame([(i, "a" if i < 40 else "b", block) for i in range(80)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.3)], "source string, weight double")
    own = mixing.apportion

    def taken(more):
        def quotas(sources, seats, votes, limit, least=None):
            return own(sources, seats, votes, limit, least).withColumn("quota", F.floor(votes_in_blocks) + more)

        votes_in_blocks = F.col("target") / block
        monkeypatch.setattr(mixing, "apportion", quotas)
        mixed, planned = mixing.mix(docs, weights)
        return {r["doc_id"]: r["taken"] for r in mixed.collect() if r["source"] == "a"}, planned.where("source = 'a'").first()

    (down, low), (up, high) = taken(0), taken(1)
    assert (low["cut"], high["cut"], high["quota"] - low["quota"]) == (False, True, 1) and low["rest"] > 0
    assert sum(down.values()) == sum(up.values()) == low["words"] == high["words"]
    assert down != up and sorted(down.values()) == sorted(up.values())
    assert sum(v > 0 for v in up.values()) == high["quota"]
    far, plan = taken(-8)
    assert sum(far.values()) == plan["words"] == (low["quota"] - 7) * block


def test_mixing_chooses_blocks_by_seed(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", 64) for i in range(400)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")

    def chosen(seed):
        return {r["doc_id"] for r in mixing.mix(docs, weights, seed=seed)[0].where("taken > 0 and source = 'a'").collect()}

    assert chosen(1) == chosen(1) != chosen(2)


def test_warc_files_end_by_compressed_size(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = read_manifest(spark, warc.write_warc(pages, file_bytes=8_000, shard_bytes=60_000)).collect()
    last = {}
    for f in files:
        last[f["shard"]] = max(f["seq"], last.get(f["shard"], -1))
    assert max(last.values()) >= 1 and len(last) > 1
    assert all(f["n_bytes"] >= 8_000 for f in files if f["seq"] < last[f["shard"]])


def test_token_files_close_by_documents(spark):
    docs = spark.createDataFrame([(7 if i % 3 else None, f"text {i % 50}") for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = tokenfile.write_tokens(docs, read_vocabulary(bound.VOCABULARY), 2, file_docs=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = read_manifest(spark, folder).collect()
    assert max(f["n_records"] for f in files) == 16 and sum(f["n_records"] for f in files) == 400
    assert len({f["shard"] for f in files}) > 2  # rows of one id, and of none, are dealt to several tasks
    rows = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: d is not None) and Counter(ids) == Counter({None: 134, 7: 266})


def test_the_classifiers_sums_do_not_depend_on_the_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, many = (quality.fit(quality.document_statistics(docs.repartition(n)), labels) for n in (1, 23))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and np.allclose(one.points, many.points)


def exact_neighbours(vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit[queries] @ unit.T
    sims[np.arange(len(queries)), queries] = -2
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def test_recall_of_the_search(spark):
    """The registered settings over the 2,000 vectors of sf0.1, several leaves, against brute force."""
    sf = "/root/testdata/sf0.1"
    table = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    vectors, ids = np.array(table["embedding"].to_pylist(), np.float64), np.array(table["vec_id"])
    assert len(vectors) > 4 * nndescent.LEAF
    queries = np.flatnonzero(ids % 50 == 0)
    expected = exact_neighbours(vectors, queries, 5)
    found = defaultdict(dict)
    for r in bound.op9_nndescent(spark, sf).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for row, q in zip(expected, queries):
        own = found[ids[q]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in own.values()} & set(ids[row].tolist()))
        for vec_id, score in own.values():
            a, b = vectors[q], vectors[np.searchsorted(ids, vec_id)]
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        assert list(own) and [own[r][1] for r in range(1, 6)] == sorted((s for _, s in own.values()), reverse=True)
    assert hits >= 0.98 * expected.size


def test_beams_grow_with_the_index():
    assert nndescent.beam_of(0) == nndescent.beam_of(10_000) == nndescent.BEAM
    assert nndescent.BEAM < nndescent.beam_of(50_000) < nndescent.beam_of(10**9)


def test_a_graph_is_a_block_for_each_bucket(spark):
    """4,500 points around one that all are near to: lists are ranked, the hub's group is split, and
    what the rounds and steps deal out is a row for many points, not one for each edge."""
    rnd = np.random.RandomState(3)
    vectors = (rnd.normal(size=(4500, 64)) * 0.125 + np.eye(64)[0]).astype(np.float32)
    vectors[0] = np.eye(64)[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    index = nndescent.build(frame)
    blocks = index.graph.collect()
    assert len(blocks) == index.buckets == 3
    ids = {r["point"]: r["ids"][0] for r in index.points.select("point", "ids").collect()}
    types, named, seen = nndescent._graph_types(index.dimension), 0, 0
    for block in blocks:
        points, _, near, sims, _ = (np.frombuffer(d, t).reshape(-1, w) if w else np.frombuffer(d, t) for d, (t, w) in zip(block["data"], types))
        assert 1000 < len(points) and (near >= 0).all() and (np.diff(sims, axis=1) <= 0).all()
        assert all(len(set(row)) == len(row) and p not in row for p, row in zip(points.tolist(), near.tolist()))
        named += sum(ids[p] == 0 for p in near.reshape(-1).tolist())
        seen += len(points)
    assert seen == 4500 and named > 4 * nndescent.GROUP
    found = defaultdict(set)
    for r in nndescent.nearest(index, frame, frame.where("vec_id % 50 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    queries = np.arange(0, 4500, 50)
    expected = exact_neighbours(vectors.astype(np.float64), queries, 5)
    assert sum(len(found[q] & set(row.tolist())) for q, row in zip(queries, expected)) >= 0.98 * expected.size


def test_lists_keep_the_nearest_of_copies():
    rnd = np.random.RandomState(4)
    row, other = rnd.randint(0, 9, 4000), rnd.randint(0, 60, 4000).astype(np.int64) << 33
    sim, flag = np.float32(rnd.randint(-8, 8, 4000) / 8)[(other >> 33) * 9 % 4000], rnd.rand(4000) < 0.5
    expected = []
    for r in range(9):
        best = {}
        for o, s, f in zip(other[row == r].tolist(), sim[row == r].tolist(), flag[row == r].tolist()):
            best[o] = min(best.get(o, (f, s)), (f, s))
        ranked = sorted((-s, o, f) for o, (f, s) in best.items())[:20]
        expected += [(r, place, o, -s, f) for place, (s, o, f) in enumerate(ranked)]
    assert list(zip(*(x.tolist() for x in nndescent._ranked(row, other, sim, flag, 20)))) == expected


def test_shuffles_go_with_the_write(spark, tmp_path):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with files.shuffles_removed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{tmp_path}/rows")
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1000


def test_every_item_is_laid_over_every_document(spark):
    """Seeds against all pairs: what aligns to half of an item or more is found."""
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()

    def split(rows):
        import pyarrow as pa

        words, firsts = decontaminate.parted(pa.array([(r["text"] or "").lower() for r in rows]))
        return [words[a:b] for a, b in zip(firsts, firsts[1:])]

    expected = {}
    for d, own in zip(docs, split(docs)):
        known = set(own.tolist())
        for i, item in zip(items, split(items)):
            if sum(w in known for w in item.tolist()) * 2 >= len(item):  # else no alignment reaches half
                score, _, _ = decontaminate.align(item, own)
                if score >= decontaminate.THRESHOLD * len(item):
                    expected[d["doc_id"], i["item_id"]] = score / len(item)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in bound.op3_decontaminate(spark, SF).collect()}
    assert expected and found.keys() == expected.keys()
    assert all(found[pair] == pytest.approx(score) for pair, score in expected.items())


def test_maps_go_on_over_runs(spark):
    folder = scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = (shards.assign_shards(docs, 4, 64, maps=folder)[1] for _ in range(2))
    assert (first.version, second.version) == (1, 2) and first.owner == second.owner
