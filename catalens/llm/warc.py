"""Web pages as WARC files and back.

The writer orders records by (page_id, url, payload digest), nulls last, and cuts that
order into shards by a running total of bytes, so neither the number of tasks nor their
order changes a file. A shard is several files' worth and is written by one task as a run
of files, a new one after the record that brings a file to `file_bytes` compressed bytes.
Every record is its own gzip member, with headers and digests made anew. Files get their
names and the manifest only after all of them are written (see `store`).

Pages are shuffled once, compressed. What each record is and where it goes is decided on
narrow rows before; the first key of every shard, MAX_SHARDS at most, tells the tasks that
compress where a page goes, and the narrow rows meet the pages in the writer. Pages that
only repeat one of the MOST_REPEATED payloads that save most are neither compressed nor
shuffled.

Of the records with equal payloads of at least `revisit_from` bytes, the one with the
largest page_id (then url) is the response; the others are revisits that point to it
and hold its HTTP header only. A null html is an empty payload, a null url
`urn:absent`, a null page_id a missing header. Equal rows are separate records: the
first is what the order makes it, the others revisit it, and however many there are, they
fill as many shards as their bytes ask for (payloads under `revisit_from`: one shard).
An empty table makes no file. Only the three columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.store import (
    ENTRY, ENTRY_ARROW, commit, materialise, open_folder, read_manifest, running_total, scratch, temporary_name,
)

#: Files' worth of plain bytes in a shard, and the number of shards beyond which they get larger.
FILES_A_SHARD, MAX_SHARDS = 4, 1 << 16
MOST_REPEATED = 4096
HEAD_BYTES = 512  # of a record, about
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6f0a4b52-7c1e-5a39-9d53-2f6a0e1b8c47")
_ORDER = ["page_id", "url", "sha1"]


def record_id(page_id: int | None, url: str | None, sha1: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{sha1}|{copy}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def member(
    page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes | None, copy: int = 0,
    refers: tuple[int | None, str | None] | None = None,
) -> bytes:
    """One gzip member: a response with its payload, or a revisit where `refers` is given."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if refers is None else b""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:absent"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id, url, sha1, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], refers[1], sha1, 0)}"]
        head += [f"X-Refers-To-Page-Id: {refers[0]}"] if refers[0] is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [
        f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_columns(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("size"), html.alias("html"),
    )


def decide(pages: DataFrame, revisit_from: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per distinct (page_id, url, payload): how often it occurs and what it refers to; and
    the payloads that several records share, with the record that holds each."""
    records = _page_columns(pages).drop("html").groupBy("page_id", "url", "sha1", "size").agg(F.count("*").alias("copies"))
    records = materialise(records)
    groups = records.where(F.col("size") >= revisit_from).groupBy("sha1", "size").agg(
        F.max(F.struct("page_id", "url")).alias("to"), F.sum("copies").alias("n")
    )
    groups = materialise(groups.where("n > 1"))  # so that the join splits a payload that very many pages share
    own = F.col("to.page_id").eqNullSafe(F.col("page_id")) & F.col("to.url").eqNullSafe(F.col("url"))
    joined = records.join(groups.select("sha1", "to"), "sha1", "left").withColumn("response", F.col("to").isNull() | own)
    return joined, groups


def _placed(decisions: DataFrame, shard_bytes: int | None, file_bytes: int) -> DataFrame:
    """A row per record and shard with the copies that go there, from copy_from up to copy_to."""
    whole, bare = F.col("size") + HEAD_BYTES, F.lit(HEAD_BYTES).cast("long")
    costs = decisions.withColumn("first_cost", F.when(F.col("response"), whole).otherwise(bare)).withColumn(
        "next_cost", F.when(F.col("to").isNull(), whole).otherwise(bare)
    )
    costs = materialise(running_total(costs, _ORDER, F.col("first_cost") + (F.col("copies") - 1) * F.col("next_cost"), "before"))
    if shard_bytes is None:
        total = costs.agg(F.sum(F.col("first_cost") + (F.col("copies") - 1) * F.col("next_cost"))).first()[0] or 0
        shard_bytes = max(FILES_A_SHARD * file_bytes, -(-total // MAX_SHARDS))
    second = F.col("before") + F.col("first_cost")

    def copies_before(end):
        """How many copies begin before byte `end`; one that has begun counts."""
        more = F.floor((end - second + F.col("next_cost") - 1) / F.col("next_cost")).cast("long")
        return F.least(F.col("copies"), 1 + F.greatest(F.lit(0).cast("long"), more))

    first = F.floor(F.col("before") / shard_bytes).cast("long")
    last = F.floor((second + (F.col("copies") - 2) * F.col("next_cost")) / shard_bytes).cast("long")
    # Without a shared payload every copy needs the page, which goes to one shard.
    spread = F.col("to").isNotNull() & (F.col("copies") > 1)
    shards = costs.withColumn("first", first).withColumn("shard", F.explode(F.sequence("first", F.when(spread, last).otherwise(first))))
    begin = F.when(F.col("shard") > F.col("first"), copies_before(F.col("shard") * shard_bytes)).otherwise(0)
    end = F.when(spread, copies_before((F.col("shard") + 1) * shard_bytes)).otherwise(F.col("copies"))
    placed = shards.withColumn("copy_from", begin.cast("long")).withColumn("copy_to", end.cast("long")).where("copy_from < copy_to")
    return placed.select("shard", *_ORDER, "size", "to", "response", "copy_from", "copy_to")


_BUILT = T.StructType([
    T.StructField("shard", T.LongType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("sha1", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("member", T.BinaryType()),
])


def _key(page_id: int | None, url: str | None, sha1: str) -> tuple:
    """Sorts as the records are ordered: ascending, nulls last."""
    return (page_id is None, page_id or 0, url is None, url or "", sha1)


def write_warc(
    pages: DataFrame, folder: str | None = None, revisit_from: int = 0, file_bytes: int = 1 << 30, shard_bytes: int | None = None
) -> str:
    """Write all pages; returns the folder of the files and their manifest."""
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    decisions, groups = decide(pages, revisit_from)
    placed = materialise(_placed(decisions, shard_bytes, file_bytes))
    flagged = F.struct(F.isnull("page_id").alias("a"), "page_id", F.isnull("url").alias("b"), "url", "sha1")
    cuts = placed.where("copy_from = 0").groupBy("shard").agg(F.min(flagged).alias("key")).orderBy("shard").collect()
    first_keys = [_key(r["key"]["page_id"], r["key"]["url"], r["key"]["sha1"]) for r in cuts]
    numbers = [r["shard"] for r in cuts]
    often = groups.orderBy(F.desc((F.col("n") - 1) * F.col("size")), "sha1").limit(MOST_REPEATED).collect()
    repeated = {r["sha1"]: (r["to"]["page_id"], r["to"]["url"]) for r in often}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages compressed before the shuffle; of equal rows in a batch, one."""
        for batch in batches:
            seen: set[tuple] = set()
            for at in range(0, batch.num_rows, 64):
                rows = []
                for page_id, url, sha1, size, html in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    key = (page_id, url, sha1)
                    if key in seen or repeated.get(sha1, key[:2]) != key[:2]:
                        continue
                    seen.add(key)
                    shard = numbers[bisect_right(first_keys, _key(*key)) - 1]
                    rows.append((shard, *key, size, member(*key, size, html.encode())))
                columns = list(zip(*rows)) or [()] * len(_BUILT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k in (0, 1, 4) else pa.binary() if k == 5 else pa.string()) for k, c in enumerate(columns)],
                    names=_BUILT.names,
                )

    built = _page_columns(pages).mapInArrow(build, _BUILT)
    narrow = placed.select(
        "shard", *_ORDER, "size", F.lit(None).cast("binary").alias("member"), F.col("to").isNotNull().alias("shared"), "response",
        F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url"), "copy_from", "copy_to",
    )
    rows = narrow.unionByName(built, allowMissingColumns=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(f"{base}/temporary", recursive=True)
        shard, seq, out, name, size, records, decision = None, 0, None, "", 0, 0, None

        def entry() -> pa.RecordBatch:
            out.close()
            row = {
                "shard": shard, "seq": seq, "name": f"pages-{shard:06d}-{seq:04d}.warc.gz", "temporary": name,
                "n_bytes": size, "n_records": records, "n_items": records,
            }
            return pa.RecordBatch.from_pylist([row], ENTRY_ARROW)

        def members(r: dict) -> Iterator[bytes]:
            """The members that a row completes. A decision comes before its page."""
            nonlocal decision
            key = (r["page_id"], r["url"], r["sha1"])
            if r["copy_to"] is not None:
                decision = r if r["response"] and r["copy_from"] == 0 else None
                first, last = r["copy_from"], r["copy_to"]
                if decision is None:
                    refers = key[:2] if r["response"] else (r["to_id"], r["to_url"])
                    yield from (member(*key, r["size"], None, copy, refers) for copy in range(first, last))
            elif decision is not None and key == (decision["page_id"], decision["url"], decision["sha1"]):
                last, shared, decision = decision["copy_to"], decision["shared"], None
                yield r["member"]
                if last > 1:
                    payload = None if shared else next(parse_members(io.BytesIO(r["member"])))[1].partition(b"\r\n\r\n")[2]
                    for copy in range(1, last):
                        yield member(*key, r["size"], payload, copy, key[:2] if shared else None)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if shard != r["shard"]:
                        if out is not None:
                            yield entry()
                        shard, seq, out, decision = r["shard"], 0, None, None
                    for data in members(r):
                        if out is None:
                            name, size, records = temporary_name(), 0, 0
                            out = store.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(data)
                        size, records = size + len(data), records + 1
                        if size >= file_bytes:
                            yield entry()
                            seq, out = seq + 1, None
        if out is not None:
            yield entry()

    order = [F.col(c).asc_nulls_last() for c in [*_ORDER, "copy_to"]]
    dealt = rows.repartition(max(1, numbers[-1] + 1 if numbers else 1), "shard").sortWithinPartitions("shard", *order)
    commit(dealt.mapInArrow(write, ENTRY), folder)
    return folder


def parse_members(stream, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file with a gzip member per record."""
    rest = b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(piece)):
                raise ValueError("file ends inside a record")
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


READ = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])
_READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("target_uri", pa.string()), ("file", pa.string()), ("payload", pa.binary()),
])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the manifest's files; digests are checked on the way.

    Revisits report the size and digest of the payload they stand for, and no payload.
    """
    files = read_manifest(spark, folder).select("name")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "name")

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in parse_members(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).hexdigest())}":
                            raise ValueError(f"block digest of {fields['WARC-Record-ID']} in {name}")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        response = fields["WARC-Type"] == "response"
                        if response and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {name}")
                        rows.append({
                            "page_id": number(fields.get("X-Page-Id")), "payload_bytes": size, "payload_digest": digest,
                            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-Id")),
                            "target_uri": fields["WARC-Target-URI"], "file": name, "payload": payload if payloads and response else None,
                        })
                        held += len(payload) if payloads else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    return files.mapInArrow(read, READ)
