"""Operator 3, WARC: archives with a two-level capture index.

Captures are sorted by reversed-host URL key.  Each task writes the records of
its key range to one archive, every record a gzip member of its own, and beside
it one index file: blocks of compressed index lines in key order, then a sparse
directory with the first key, offset and length of every block.  The manifest
has one row per index file with its first and last key.  A lookup finds the
index files by binary search over the manifest, the block by binary search over
the directory, the lines by binary search in the block, and then reads just the
bytes of the records.

Of the records with equal payloads of at least MIN_SHARED bytes, the one with
the largest page id is a response and the others revisit it.

Defined results: a null html is an empty payload; a null URL is the empty key;
repeated rows are records of their own; an empty table writes no file and gives
an empty result; extra columns are left out.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .store import Sink, Source, new_file, write

MIN_SHARED = 1000
#: Index lines in a compressed block.
BLOCK = 128
#: Records are read together while they lie next to each other, up to so many bytes.
SPAN = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: com,example,blog)/en/7198 -- case of the host and the scheme do not count."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"#.*$", "")
    return F.when(u == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record.  A revisit carries headers only and names the payload's length."""
    name = "null" if page_id is None else str(page_id)
    lines = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers is None:
        body, kind = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload, "application/http; msgtype=response"
    else:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Refers-To-Target-URI", re.sub(r"[\r\n]", "", refers_url or ""))]
        body, kind = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload), "application/http; msgtype=response"
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Type", kind), ("Content-Length", str(len(body)))]) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def file_info(name: str) -> bytes:
    """The warcinfo record that begins an archive."""
    body = b"software: tesserine\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Filename": name, "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": str(len(body))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and, for a response, the payload; a revisit has the stated payload length instead."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = re.fullmatch(r"<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
    refers = re.fullmatch(r"<urn:page:(.*)>", fields.get("WARC-Refers-To", "")) if fields["WARC-Type"] == "revisit" else None
    return {
        "page_id": None if page == "null" else int(page),
        "type": fields["WARC-Type"],
        "url": fields["WARC-Target-URI"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if refers is None else None,
        "length": length,
        "refers_to": int(refers[1]) if refers else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows of one key range in key order; a row of kind 0 tells what the page rows of kind 1 after it revisit."""
    sink, lines, role = None, [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "page_id", "digest", "kind", "refers", "refers_url", "url", "html")]
        for key, page, digest, kind, refers, refers_url, url, html in zip(*columns, strict=True):
            if kind == 0:
                role = (key, page, digest, refers, refers_url)
                continue
            if sink is None:
                sink = Sink(new_file(folder, ".warc.gz"))
                sink.put(gzip.compress(file_info(sink.uri.rpartition("/")[2]), 1, mtime=0))
            named = role is not None and role[:3] == (key, page, digest)
            payload = (html or "").encode()
            member = gzip.compress(record(page, url or "", payload, hashlib.sha1(payload).hexdigest(), role[3] if named else None, role[4] if named else None), 1, mtime=0)
            lines.append((key, sink.put(member), len(member)))
    if sink is None:
        return
    sink.close()
    body, directory = b"", []
    for at in range(0, len(lines), BLOCK):
        block = zlib.compress("\n".join(json.dumps(x) for x in lines[at : at + BLOCK]).encode(), 6)
        directory.append((lines[at][0], len(body), len(block)))
        body += block
    tail = zlib.compress(json.dumps({"warc": sink.uri, "blocks": directory}).encode())
    uri = new_file(folder, ".idx")
    write(uri, body + tail + len(tail).to_bytes(8, "little"))
    yield pa.RecordBatch.from_pydict({"uri": [uri], "first": [lines[0][0]], "last": [lines[-1][0]], "captures": pa.array([len(lines)], pa.int64())})


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html -> archives and their index under ``folder``; returns the manifest.

    Which record revisits which is settled on ids and digests alone; those few
    rows then travel to the same key ranges as the pages, so the html is
    shuffled once.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"), "url", "html")
    big = materialise(page.filter((F.col("bytes") >= MIN_SHARED) & F.col("page_id").isNotNull()).select("key", "page_id", "digest", "url"), "captures")
    shared = big.groupBy("digest").agg(F.max_by(F.struct(F.col("page_id").alias("refers"), F.col("url").alias("refers_url")), "page_id").alias("r"), F.count("*").alias("n")).filter("n > 1").select("digest", "r.*")
    roles = big.drop("url").join(shared, "digest").filter("page_id <> refers").distinct()
    roles = roles.select("key", "page_id", "digest", F.lit(0).alias("kind"), "refers", "refers_url", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = page.select("key", "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers"), F.lit(None).cast("string").alias("refers_url"), "url", "html").unionByName(roles)
    order = ["key", "page_id", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    return materialise(dealt.mapInArrow(lambda it: _write(it, folder), "uri string, first string, last string, captures long"), "manifest")


class Index:
    """One index file: the directory in memory, blocks read as they are asked for."""

    def __init__(self, source: Source):
        self._source, end = source, source.size()
        tail = int.from_bytes(source.range(end - 8, 8), "little")
        found = json.loads(zlib.decompress(source.range(end - 8 - tail, tail)))
        self.warc, self._blocks = found["warc"], found["blocks"]
        self._first = [b[0] for b in self._blocks]
        self._held: tuple[int, list] = (-1, [])

    def _block(self, k: int) -> list:
        if self._held[0] != k:
            _, at, length = self._blocks[k]
            self._held = (k, [json.loads(x) for x in zlib.decompress(self._source.range(at, length)).decode().split("\n")])
        return self._held[1]

    def find(self, key: str) -> Iterator[tuple[int, int]]:
        """Offset and length of every capture of a key."""
        k = max(0, bisect.bisect_left(self._first, key) - 1)
        while k < len(self._blocks) and self._first[k] <= key:
            lines = self._block(k)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at][1], lines[at][2]
                at += 1
            k += 1


def _records(source: Source, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The members at these places; neighbours are read in one range."""
    at = 0
    while at < len(spans):
        to, begin = at + 1, spans[at][0]
        while to < len(spans) and spans[to][0] == sum(spans[to - 1]) and sum(spans[to]) - begin <= SPAN:
            to += 1
        raw = source.range(begin, sum(spans[to - 1]) - begin)
        for offset, length in spans[at:to]:
            yield gzip.decompress(raw[offset - begin : offset - begin + length])
        at = to


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows uri, key in this order: each index file is opened once, its records come in archive order."""

    def read(uri: str, keys: list[str]) -> Iterator[pa.RecordBatch]:
        with Source(uri) as source:
            index = Index(source)
            with Source(index.warc) as archive:
                for at in range(0, len(keys), 512):
                    rows = []
                    for raw in _records(archive, [s for k in keys[at : at + 512] for s in index.find(k)]):
                        r = parse(raw)
                        digest = r["digest"] if r["payload"] is None else hashlib.sha1(r["payload"]).hexdigest()
                        rows.append((r["page_id"], r["url"], r["length"] if r["payload"] is None else len(r["payload"]), digest, r["type"], r["refers_to"]))
                    if rows:
                        page, url, size, digest, kind, refers = (list(c) for c in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_pydict({"page_id": pa.array(page, pa.int64()), "url": url, "payload_bytes": pa.array(size, pa.int64()), "payload_digest": digest, "record_type": kind, "refers_to": pa.array(refers, pa.int64())})

    held, keys = None, []
    for batch in batches:
        for uri, key in zip(batch.column("uri").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if uri != held and keys:
                yield from read(held, keys)
                keys = []
            held = uri
            keys.append(key)
    if keys:
        yield from read(held, keys)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures of the distinct ``key`` values: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A key can lie in several index files (one URL may have very many captures),
    so each key goes to every file whose range holds it.  The ranges do not
    overlap but at their ends; the list of files is as long as the list of the
    writing tasks, and each key finds its files by binary search over it.
    """
    files = sorted((r["first"], r["last"], r["uri"]) for r in manifest.select("first", "last", "uri").collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uri, key = [], []
            for k in batch.column("key").to_pylist():
                for at in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
                    uri.append(files[at][2])
                    key.append(k)
            yield pa.RecordBatch.from_pydict({"uri": pa.array(uri, pa.string()), "key": pa.array(key, pa.string())})

    routed = keys.select("key").distinct().mapInArrow(route, "uri string, key string")
    dealt = routed.repartitionByRange(max(1, len(files)), "uri") if files else routed
    return dealt.sortWithinPartitions("uri", "key").mapInArrow(_fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, shared_dir(spark, "warc"))
    return lookup(manifest, pages.select(url_key(F.col("url")).alias("key"))).drop("url")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest) as newest from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> newest then newest end as refers_to
from g
"""
