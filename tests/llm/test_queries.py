"""The queries over whole small tables, against plain Python over the same rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from catalens.llm import queries as bound
from catalens.llm.vocab import read_vocabulary

SF = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def run(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in bound.queries()[name](spark, SF).collect()]
        return kept[name]

    return run


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def test_warc(result):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table("pages")}
    largest = {}
    for page_id, html in pages.items():
        largest[html] = max(page_id, largest.get(html, page_id))
    rows = result("op1_warc")
    assert len(rows) == len(pages)
    for r in rows:
        html = pages[r["page_id"]]
        assert r["payload_bytes"] == len(html)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        first = largest[html]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


def test_chat(result):
    turns = defaultdict(list)
    for r in table("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-1] = [(0, "user", bound.CONTROL_TEXT), (1, "assistant", bound.CONTROL_TEXT)]
    rows = {r["conv_id"]: r for r in result("op2_chat")}
    assert rows.keys() == turns.keys()
    for conv_id, own in turns.items():
        own.sort()
        learned = "".join(t for _, role, t in own if role == "assistant")
        r = rows[conv_id]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_shards(result, documents):
    rows = result("op4_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        data = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(load) == set(range(16))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def ids_of(documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(read_vocabulary(bound.VOCABULARY))
    return {d: x.ids for d, x in zip(documents, model.encode_batch(list(documents.values()), add_special_tokens=False))}


def test_tokens(result, documents):
    expected, at = ids_of(documents), 0
    rows = {r["doc_id"]: r for r in result("op6_tokens")}
    assert rows.keys() == documents.keys()
    for doc_id in sorted(documents):
        ids = [*expected[doc_id], 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc)
        at += len(ids)


def test_token_counts(result, documents):
    expected = ids_of(documents)
    rows = result("op8_tokencount")
    assert len(rows) == len(documents)
    for r in rows:
        n = len(expected[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), n, n > 1024)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_decontamination(result, documents):
    plain = lambda text: " ".join(re.sub(r"[\x00-\x7F]", lambda m: m[0] if m[0].isalnum() else " ", text.lower()).split())
    items = {r["item_id"]: plain(r["text"]) for r in table("benchmark")}
    copies = {(d, i) for d, text in documents.items() for i, item in items.items() if f" {item} " in f" {plain(text)} "}
    rows = result("op3_decontaminate")
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["score"] == 1.0} == copies
    for r in rows:
        own = plain(documents[r["doc_id"]]).split()[r["first_word"] : r["end_word"]]
        item = items[r["item_id"]].split()
        assert len(set(own) & set(item)) >= 0.4 * len(set(item))


def test_mixing(result):
    own = table("documents")
    sizes = {r["doc_id"]: len(words(r["text"] or "")) for r in own}
    source = {r["doc_id"]: r["source"] for r in own}
    names = sorted(set(source.values()), key=lambda s: (s is None, s))
    total = {s: sum(n for d, n in sizes.items() if source[d] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        free -= set(over)
    target |= share
    rows, taken = result("op7_mixing"), Counter()
    assert sorted(r["doc_id"] for r in rows) == sorted(sizes)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 64 for s in names)


def test_quality(spark):
    rows = [r.asDict() for r in bound.op10_quality(spark, "/root/testdata/sf0.01").collect()]
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert len(rows) == 1000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    unseen = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == q for p, q in unseen) >= 0.95 * len(unseen)
    bad = [p for p, q in unseen if q == 0]
    assert sum(bad) <= 0.2 * len(bad)


def brute_components(texts, n, percent):
    sets = {}
    for d, text in texts.items():
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
        sets[d] = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    r, s = sorted((root(a), root(b)))
                    parent[s] = r
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    expected = brute_components(texts, 2, 80)
    rows = bound.op5_minhash(spark, sf).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len({c for _, c in expected.values()}) < len(texts)
