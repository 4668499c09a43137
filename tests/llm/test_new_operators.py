"""License scans, centroid clustering and fill-in-the-middle against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalens.llm import centroids, infill, licenses
from catalens.llm import queries as bound

SF = "/root/testdata/sf0.001"
EXTRA = "size long, label string, found string, form string, n long, output string, cluster int, distance long, text_row int, h1 int, _digest int"


def widened(spark, rows, schema):
    """A frame whose other columns have the names that the operators use themselves."""
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame(rows, schema)
    extra = [c for c in EXTRA.split(", ") if c.split()[0] not in names]
    return frame.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in extra})


# --- licenses ---------------------------------------------------------------


def plain_scan(text, templates=licenses.TEMPLATES):
    """Every place and template tried on its own."""
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for t in templates:
        hits = []
        (first, opening), *others = t.keys
        for place in range(len(words) - len(opening) + 1):
            if words[place : place + len(opening)] != opening:
                continue
            origin = place - first

            def near(start, key):
                low, high = max(0, origin + start - t.slack), origin + start + t.slack
                return any(words[p : p + len(key)] == key for p in range(low, min(high, len(words) - len(key)) + 1))

            if not all(near(start, key) for start, key in others):
                continue
            share = sum(near(i, [w]) for i, w in enumerate(t.words)) / len(t.words)
            if share >= licenses.COVER:
                hits.append((place, share))
        if hits:
            found.append((t.label, t.base, len(hits), hits[0][0], hits[-1][0], max(s for _, s in hits)))
    return len(words), found


MIT = licenses.NOTICES[[t.label for t in licenses.NOTICES].index("mit") + 1].text
BSD = next(t.text for t in licenses.NOTICES if t.label == "bsd")
LICENSED = [
    None, "", "no licence here", "CC BY", "cc, by; CC-BY-NC 4.0! cc by", "ccby cc_by é cc by", "All rights\nRESERVED. all rights. reserved all rights reserved",
    "GNU General Public License, version 3 and GNU GENERAL PUBLIC LICENSE VERSION 2", MIT.upper(), f"xx {MIT} yy {BSD}",
    " ".join(w for i, w in enumerate(MIT.split()) if i not in (9, 14, 19)), MIT.replace("without restriction", "with restriction"),
    MIT.replace("to any person", "to any person or firm whatever"), " ".join(MIT.split()[:10]), " ".join(reversed(MIT.split())),
    "word " * 5000 + "released under the MIT License " + "other " * 5000, "cc by " * 3000, "public domain " + "x " * 20 + "free and unencumbered software",
    "This is free and unencumbered software released into the public domain", "general public", "license general public license", "CC\x00BY", "cc by",
]


def test_licenses_equal_the_plain_scan(spark):
    docs = widened(spark, list(enumerate(LICENSED)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(LICENSED)
    for doc_id, text in enumerate(LICENSED):
        n, found = plain_scan(text)
        assert (rows[doc_id]["n_words"], [tuple(f) for f in rows[doc_id]["found"]]) == (n, found), text
    labels = {r["doc_id"]: r["labels"] for r in licenses.label_documents(docs).collect()}
    assert labels[4] == "cc-by,cc-by-nc" and labels[8] == labels[10] == labels[12] == "mit" and labels[9] == "bsd,mit"
    assert labels[7] == "gpl,gpl-2.0,gpl-3.0" and labels[18] == "unlicense" and labels[11] == labels[13] == labels[14] == ""


def test_which_words_are_rare_does_not_change_the_result(spark):
    """The lookup order follows the corpus, what is found does not."""
    docs = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    noise = spark.createDataFrame([(1000 + i, "mit cc hereby granted conditions unencumbered 0 reserved") for i in range(50)], docs.schema)
    alone = Counter(map(str, licenses.scan(docs).collect()))
    among = Counter(map(str, licenses.scan(docs.unionByName(noise)).where("doc_id < 1000").collect()))
    assert alone == among
    assert licenses.document_frequencies(docs.unionByName(noise))["hereby"] == 50 + sum("hereby" in (t or "").lower().split() for t in LICENSED)


def test_licenses_of_odd_tables(spark):
    rows = [(1, "cc by"), (1, "cc by"), (None, "mit license"), (None, None)]
    found = licenses.label_documents(widened(spark, rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["labels"], r["score"]) for r in found) == Counter([
        (1, "cc-by", 1.0), (1, "cc-by", 1.0), (None, "mit", 1.0), (None, "", 0.0),
    ])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- centroids --------------------------------------------------------------


def plain_clusters(vectors, k, rounds, seed=3):
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    middle = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        members = [[] for _ in middle]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        middle = [[sum(column) // len(own) for column in zip(*own)] if own else c for own, c in zip(members, middle)]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), middle


def clustered(frame, **options):
    assigned, found = centroids.cluster_vectors(frame, **options)
    return assigned, found, Counter(tuple(r) for r in assigned.collect())


def test_clusters_of_odd_vectors(spark):
    random = np.random.RandomState(5)
    rows = [(i, random.normal(0, 3, 64).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (70, [0.0] * 64), (71, [-1e-9] * 64)]
    odd = [(80, None), (81, [1.0] * 63), (82, [1.0] * 63 + [None]), (83, [float("nan")] * 64), (84, [float("-inf")] + [0.0] * 63), (85, [])]
    frame = widened(spark, rows + odd, "vec_id long, embedding array<double>")
    for k, rounds in ((8, 10), (5, 1), (3, 0), (200, 2)):
        expected, middle = plain_clusters(rows + odd, k, rounds)
        _, found, got = clustered(frame, k=k, rounds=rounds)
        assert got == expected and found.tolist() == middle
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    assigned, found, got = clustered(same)
    assert got == Counter({(i, 0, 0): 1 for i in range(20)}) and len(found) == 8
    assert centroids.with_inertia(assigned, found).first()["inertia"] == 0
    empty, none, got = clustered(frame.limit(0))
    assert not got and len(none) == 0 and centroids.with_inertia(empty, none).count() == 0


def test_components_too_large_for_the_distance_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="scaled components"):
        centroids.cluster_vectors(frame)


def test_bounds_leave_most_centroids_unmeasured_and_lose_none(spark):
    vectors = pq.read_table(f"{SF}/embeddings.parquet")
    units = np.floor(np.array(vectors["embedding"].to_pylist()) * 1024).astype(np.int64)
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    _, found = centroids.cluster_vectors(frame)
    rotation = centroids.fit_rotation(centroids.whole_vectors(frame, 64), 64, 1024.0, 0.75)
    nearest = centroids.Nearest(found, rotation)

    def stored(vectors):
        lead, rest = rotation(vectors)
        return lead.astype(np.float32).astype(np.float64), rest

    cluster, distance = nearest(units, *stored(units))
    exact = ((units[:, None] - found) ** 2).sum(axis=2)
    assert (exact.argmin(axis=1) == cluster).all() and (exact.min(axis=1) == distance).all()
    assert nearest.measured < nearest.seen / 2
    far = units * 100_000  # rounding of large numbers
    cluster, distance = nearest(far, *stored(far))
    exact = ((far[:, None] - found) ** 2).sum(axis=2)
    assert (exact.argmin(axis=1) == cluster).all() and (exact.min(axis=1) == distance).all()


# --- fill in the middle -----------------------------------------------------

TEXTS = [None, "", "a", "ab", "<P>", "x<S>y", "a<M", "<", "é😀́ü", "line\nbreak\r\n\ttab", "ends <", "> starts", "<<P", "word " * 4000, "漢字" * 700, "\x00\x01"]


def plain_form(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted([h[0] % (len(text) + 1), h[1] % (len(text) + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_infill_equals_plain_slices(spark, monkeypatch, window):
    monkeypatch.setattr(infill, "WINDOW", window)
    h = np.random.RandomState(1).randint(0, 1 << 32, (2, len(TEXTS)), dtype=np.int64)
    n, (low, high), pieces = infill.cut(pa.array(TEXTS, pa.large_string()), *h)
    for i, text in enumerate(TEXTS):
        text = text or ""
        assert n[i] == len(text)
        assert [p[i].as_py() for p in pieces] == [text[: low[i]], text[low[i] : high[i]], text[high[i] :]]


def test_infill_forms_and_restores(spark):
    rows = [(37 * i + j, t) for i, t in enumerate(TEXTS) for j in range(12)] + [(5, "twice"), (5, "twice"), (None, "no id"), (None, None)]
    formed = infill.transform(widened(spark, rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in formed.collect())
    assert got == Counter(plain_form(*r) for r in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    back = infill.restore(formed.withColumn("restored", F.lit(0)))
    assert Counter((r["doc_id"], r["restored"]) for r in back.collect()) == Counter((d, t or "") for d, t in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.transform(none)).count() == 0


@pytest.mark.parametrize("unit, pattern", [("word", r"\S*\s+|\S+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_infill_of_larger_units(unit, pattern):
    texts = ["one two  three\nfour", "", " lead", "a\n\nb\n", "solo", "é ü\tö "]
    h = np.random.RandomState(2).randint(0, 1 << 32, (2, len(texts)), dtype=np.int64)
    n, (low, high), pieces = infill.cut(pa.array(texts, pa.large_string()), *h, unit=unit)
    for i, text in enumerate(texts):
        units = re.findall(pattern, text)
        assert n[i] == len(units)
        assert [p[i].as_py() for p in pieces] == ["".join(units[: low[i]]), "".join(units[low[i] : high[i]]), "".join(units[high[i] :])]


# --- the queries ------------------------------------------------------------


def test_license_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = {r["doc_id"]: r for r in bound.op11_licenses(spark, SF).collect()}
    for d in docs:
        n, found = plain_scan(d["text"])
        base = [f for f in found if f[1]]
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["labels"]) == (n, sum(f[2] for f in base), ",".join(sorted({f[0] for f in found})))
        assert (r["first_word"], r["last_word"]) == (min((f[3] for f in base), default=None), max((f[4] for f in base), default=None))
