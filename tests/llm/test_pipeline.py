"""The pipeline, stage by stage, against plain Python over the rows each stage got."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalens.llm import mixing, quality
from catalens.llm.store import materialise
from tests.llm.test_edges import ROWS, SCHEMA
from tests.llm.test_queries import brute_components, words

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "decontamination", "mixing", "sharding",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        rows = docs.collect()
        assert docs.columns == columns and all(before[r["doc_id"]] == r for r in rows)
        after = Counter(r["doc_id"] for r in rows)
        texts = {d: r["text"] or "" for d, r in before.items()}
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            model = quality.fit(quality.document_statistics(spark.createDataFrame(list(before.values()), docs.schema)), labels)
            scores = model.score(quality.statistics(pa.array(list(texts.values()))))
            assert set(after) == {d for d, s in zip(texts, scores) if s >= 0.5}
            known = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
            assert sum(known[d] == 0 for d in after if d in known) <= 0.2 * sum(q == 0 for q in known.values())
        elif name == "near-duplicates":
            assert set(after) == {c for _, c in brute_components(texts, 5, 80).values()}
        elif name == "decontamination":
            plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
            items = [plain(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
            leaks = {d for d, t in texts.items() if any(i in plain(t) for i in items)}
            assert leaks and set(after) == set(texts) - leaks
        if name != "mixing":
            assert max(after.values()) == 1
            before = {r["doc_id"]: r for r in rows}
        else:
            assert max(after.values()) <= 3 and all(after[d] for d, t in texts.items() if not words(t))
            size = Counter()
            for d, t in texts.items():
                size[before[d]["source"]] += len(words(t))
            taken = Counter()
            for d, n in after.items():
                taken[before[d]["source"]] += n * len(words(texts[d]))
            plan = {r["source"]: r for r in mixing.plan(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
            for source, total in taken.items():
                # Whole documents stand for their words by chance: off by some of the largest.
                largest = max(len(words(t)) for d, t in texts.items() if before[d]["source"] == source)
                assert abs(total - plan[source]["target"]) <= 0.25 * plan[source]["target"] + 3 * largest
            assert 0.7 <= sum(taken.values()) / sum(size.values()) <= 1.3
    sharded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r["doc_id"] for r in sharded.collect()) == after
    load = {r["shard"]: r["n"] for r in sharded.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    largest = max(len((r["text"] or "").encode()) for r in rows) + 1
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 3 * largest
    assert sharded.select("virtual_slot", "shard").distinct().groupBy("virtual_slot").count().where("count > 1").count() == 0


def test_pipeline_on_no_rows(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


@pytest.fixture
def odd(spark, tmp_path):
    """Null ids, repeated rows, empty and null texts, and columns named like those of the stages."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, rows = docs.columns, {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        # Each stage on all the rows, whatever the one before made of them.
        out = stage(spark, docs, odd)
        kept = Counter(tuple(r) for r in out.collect())
        assert out.columns == columns and kept and set(kept) <= rows, name
        if name == "near-duplicates":
            assert max(kept.values()) == 1
        if name == "decontamination":
            assert kept == Counter(tuple(r) for r in docs.collect())  # the test items of these rows are others
        if name == "mixing":
            assert {r for r in rows if not words(r[1] or "")} <= set(kept)
    sharded = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert set(sharded.columns) == {*columns, "virtual_slot", "input_shard"}
    assert Counter(r["input_shard"] for r in sharded.collect()) == Counter(r[columns.index("shard")] for r in map(tuple, docs.collect()))
    assert set(corpus_pipeline.run(spark, odd).columns) == {*columns, "virtual_slot", "input_shard"}


def test_runs_leave_only_what_the_result_reads(spark):
    from pathlib import Path

    from catalens.llm.store import scratch, scratch_area

    root = Path(scratch(spark).removeprefix("file:")).parent
    before = set(root.iterdir()) if root.exists() else set()
    result = corpus_pipeline.run(spark, SF)
    left = set(root.iterdir()) - before
    assert result.count() > 0 and len(left) <= 3  # the mixed documents, the map and its sizes
    with scratch_area(spark) as area:
        kept = materialise(spark.range(3))
        assert kept.inputFiles()[0].startswith(f"file://{area.removeprefix('file:')}".replace("file:////", "file:///"))
    assert not Path(area.removeprefix("file:")).exists()
