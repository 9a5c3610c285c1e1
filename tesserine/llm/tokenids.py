"""Operator 6, token ids as binary files with Elias-Fano document boundaries.

A file holds the ids of its documents one after another, and two Elias-Fano
sequences: where each document begins, and the document ids.  Each value costs
about two bits plus the logarithm of its mean gap; sampled select positions
return any boundary by reading a few words, so there is no table of 64-bit
offsets.

File layout, all integers little-endian:

    8 bytes   magic
    6 x u64   documents, null ids at the start, ids, bytes per id,
              length of the boundary section, length of the document-id section
    ...       ids, then the boundary section, then the document-id section

An Elias-Fano section is: 3 x u64 (values, low bits, bytes of the high bitmap),
packed low bits, the high bitmap, and one u32 for every 256th set bit.

Defined results: a null or empty text holds the end id alone; a null document id
sorts first; equal ids follow each other in any order; an empty table writes no
file and gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shared_dir
from .store import Source, new_file, write

MAGIC = b"TSSRIDS1"
SAMPLE = 256
#: A file is closed after so many ids.
FILE_IDS = 16_000_000
#: Pieces, and pre-tokens, whose ids a worker remembers: up to about 400 MB for both.
REMEMBER = 1_000_000
END_ID = 2
#: Documents that are read together.
READ = 2000
#: A space between two white-space characters: only there may a token cross a cut before a space.
INNER_SPACE = re.compile(r"\s \s")


#: Fixed value: how byte-level vocabularies of this family cut a text into pre-tokens.
PRE_TOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def ef_encode(values: np.ndarray) -> bytes:
    """An Elias-Fano section of a non-decreasing sequence of non-negative integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low = max(0, (top // max(1, n)).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    high[at] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    head = np.array([n, low, len(packed)], "<u8").tobytes()
    return head + lows + packed + at[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Values of a section.  The place of any set bit is found through the nearest select sample before it."""

    def __init__(self, section: bytes):
        self.n, self.low, size = (int(x) for x in np.frombuffer(section, "<u8", 3))
        lows = (self.n * self.low + 7) // 8
        self._lows = np.frombuffer(section, np.uint8, lows, 24)
        self._high = np.frombuffer(section, np.uint8, size, 24 + lows)
        self._samples = np.frombuffer(section, "<u4", -1, 24 + lows + size)

    def _select(self, begin: int, end: int) -> np.ndarray:
        """Places of the set bits ``begin`` to ``end`` in the high bitmap: only the bits between two samples are read."""
        first, last = begin // SAMPLE, -(-end // SAMPLE)
        start = int(self._samples[first])
        stop = int(self._samples[last]) if last < len(self._samples) else len(self._high) * 8
        bits = np.unpackbits(self._high[start // 8 : stop // 8 + 1], bitorder="little")[start % 8 :]
        ones = np.flatnonzero(bits)[begin - first * SAMPLE : end - first * SAMPLE]
        return ones + start

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The values from ``begin`` to ``end``."""
        if begin >= end:
            return np.zeros(0, np.int64)
        high = self._select(begin, end) - np.arange(begin, end)
        first = begin * self.low
        window = np.unpackbits(self._lows[first // 8 : (end * self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + (end - begin) * self.low]
        return (high.astype(np.int64) << self.low) + window.reshape(end - begin, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def get(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def file_bytes(doc_ids: list, counts: np.ndarray, ids: bytes, width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = ef_encode(np.concatenate([[0], np.cumsum(counts)]))
    names = np.array([base], "<i8").tobytes() + ef_encode(known.astype(object) - base if len(known) else known)
    head = np.array([len(doc_ids), nulls, len(ids) // width, width, len(ends), len(names)], "<u8").tobytes()
    return MAGIC + head + ids + ends + names


class TokenFile:
    """A file as written by ``file_bytes``, read by byte ranges."""

    def __init__(self, source: Source):
        head = source.range(0, 56)
        if head[:8] != MAGIC:
            raise ValueError("not a token id file")
        self.docs, self.nulls, self.ids, self.width, ends, names = (int(x) for x in np.frombuffer(head, "<u8", 6, 8))
        self._source, at = source, 56 + self.ids * self.width
        self.ends = EliasFano(source.range(at, ends))
        section = source.range(at + ends, names)
        self._base, self._known = int(np.frombuffer(section, "<i8", 1)[0]), EliasFano(section[8:])

    def doc_ids(self, begin: int, end: int) -> list:
        """The ids of the documents from ``begin`` to ``end``."""
        known = self._known.slice(max(0, begin - self.nulls), max(0, end - self.nulls))
        return [None] * (min(end, self.nulls) - min(begin, self.nulls)) + (known + self._base).tolist()

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by two select queries and one range read."""
        begin, end = self.ends.get(k), self.ends.get(k + 1)
        return self.span(begin, end)

    def span(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self._source.range(56 + begin * self.width, (end - begin) * self.width), f"<u{self.width}")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others from 256 on in byte order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Tokens(dict):
    """Pre-tokens -> their ids as bytes; a new one goes straight to the model."""

    def __init__(self, tokenizer, code: str):
        super().__init__()
        self._merge, self._code, self._letters = tokenizer.model.tokenize, code, byte_letters()

    def __missing__(self, token: str) -> bytes:
        spelled = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
        ids = array(self._code, [t.id for t in self._merge(spelled)]).tobytes()
        if len(self) < REMEMBER:
            self[token] = ids
        return ids


class Pieces(dict):
    """Text pieces that begin with a space (left out of the key) -> their ids as bytes."""

    def __init__(self, tokenizer, code: str):
        super().__init__()
        self._encode, self._code, self._tokens = tokenizer.encode, code, Tokens(tokenizer, code)

    def raw(self, text: str) -> bytes:
        return array(self._code, self._encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if "<|" in piece:  # perhaps a special token: for the tokenizer to tell
            ids = self.raw(" " + piece)
        else:
            ids = b"".join(map(self._tokens.__getitem__, PRE_TOKEN.findall(" " + piece)))
        if len(self) < REMEMBER:
            self[piece] = ids
        return ids


def cuts_as_known(tokenizer) -> bool:
    """Does the tokenizer cut texts as ``PRE_TOKEN`` does, with no other rule, and mark its special tokens by ``<|``?"""
    told = json.loads(tokenizer.to_str())
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(plain and merges and not told.get("normalizer") and all("<|" in t["content"] and not t.get("lstrip") and not t.get("rstrip") for t in told["added_tokens"]))


class Encoder:
    """Ids of texts as bytes; pieces seen before are not encoded again.

    The tokenizer never joins a space to what stands before it, so a text may be
    cut before each space and the pieces encoded apart, unless white space
    stands on both sides of the space; such texts are encoded whole.  A tokenizer
    with rules of another kind encodes all texts whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self._pieces = Pieces(tokenizer, "H" if self.width == 2 else "I")
        self._end, self._known = end_id.to_bytes(self.width, "little"), cuts_as_known(tokenizer)

    def __call__(self, text: str) -> bytes:
        if not self._known or INNER_SPACE.search(text):
            return self._pieces.raw(text) + self._end
        first, *rest = text.split(" ")
        return self._pieces.raw(first) + b"".join(map(self._pieces.__getitem__, rest)) + self._end


#: One encoder per Python worker: its remembered pieces serve all tasks that the worker runs.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, seq = None, TaskContext.get().partitionId(), 0
    names: list = []
    chunks: list[bytes] = []

    def flush() -> pa.RecordBatch:
        nonlocal seq
        counts = np.array([len(c) for c in chunks], np.int64) // encode.width
        uri = new_file(folder, ".ids")
        write(uri, file_bytes(names, counts, b"".join(chunks), encode.width))
        row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "uri": [uri], "docs": pa.array([len(names)], pa.int64()), "ids": pa.array([int(counts.sum())], pa.int64())})
        seq += 1
        names.clear()
        chunks.clear()
        return row

    held = 0
    for batch in batches:
        encode = encode or encoder(path, end_id)
        ids, texts = batch.column("doc_id"), batch.column("text")
        for at in range(0, batch.num_rows, 1000):
            got = [encode(t or "") for t in texts.slice(at, 1000).to_pylist()]
            names.extend(ids.slice(at, 1000).to_pylist())
            chunks.extend(got)
            held += sum(map(len, got))
            if held > FILE_IDS * encode.width:
                yield flush()
                held = 0
    if names:
        yield flush()


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with Source(uri) as source:
                f = TokenFile(source)
                for at in range(0, f.docs, READ):
                    to = min(f.docs, at + READ)
                    ends = f.ends.slice(at, to + 1)  # offsets of these documents only, by select
                    ids, begin = f.span(int(ends[0]), int(ends[-1])).astype("<u4"), int(ends[0])
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends[:-1] - begin).tolist(), (ends[1:] - begin).tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.doc_ids(at, to), pa.int64()), "start": pa.array(ends[:-1] + start, pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode doc_id, text into files in ascending doc_id order; returns the manifest: uri, docs, ids, start."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first()).drop("_tie")
    written = dealt.mapInArrow(lambda it: _write_files(it, folder, tokenizer_path, end_id), "part long, seq long, uri string, docs long, ids long")
    files = materialise(written, "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    spread = manifest.select("uri", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_elias_fano_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-ids"))
    return read_token_files(manifest)
