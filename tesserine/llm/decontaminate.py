"""Operator 9, benchmark decontamination: CGK random-walk embedding with bit-sampling LSH.

Words are compared without case and punctuation.  The CGK walk reads a window
word by word; at each step it emits the word under it and a random bit for that
step and word says whether it moves on.  Two texts that differ by few word edits
fall back into step soon, so their emitted sequences differ in few places: edit
distance becomes Hamming distance.  A key samples SAMPLES steps of the walk, which
must stand on at least DISTINCT words; there are several repetitions with bits and
steps of their own, more of them if an item has too few keys.  Every word position
of every document starts a window, and so does every position of an item whose
samples stay inside it.  Windows that meet an item under one key are verified by
the exact edit distance between the whole item and the nearest passage around
the window.

A document is contaminated by an item of n words if some passage of it is within
n // 5 word edits (0 for items under ten words).  Items under MIN_WORDS words are
no evidence inside a longer text: they match a document that has their words and
no others.  An item that gets too few keys from all repetitions gets keys of a walk
that always moves on, so every item has one.

The items are dealt in the order of their rows into blocks of a bounded number of words.  Tasks
build the index of each block and write it to the shared folder; each block is one
pass over the documents, whose tasks read the index once a worker.

Defined results: null, empty or blank texts and items match nothing; repeated
documents or items are reported each; a null id is reported as null; empty
tables give an empty result; extra columns are left out.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.scans import running
from tesserine.session import spread

from .common import materialise, shared_dir, small_or_shuffled
from .store import Source, new_file, write

MIN_WORDS, RATE, LEAST_EDITED = 5, 5, 10
#: Steps of the walk that the samples of each repetition come from: short walks for items with many edits, long ones for few chance hits.
SHORTEST = 5
REPETITIONS = (SHORTEST, SHORTEST, 9, 9, 16, 16)
SAMPLES, DISTINCT = 4, 3
#: Repetitions of the shortest walk are added until every item has so many keys; after MOST of them comes one that always moves on.
LEAST_KEYS, MOST = 3, 40
_MULTIPLY = np.int64(0x5851F42D4C957F2D)
SEED = 20_240_509
#: Words of the items in one block (an index takes about 500 bytes a word).
BLOCK_WORDS = 500_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits_allowed(n: int) -> int:
    return n // RATE if n >= LEAST_EDITED else 0


def nearest(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the item to any passage of the text, and where that passage ends (bit-parallel)."""
    n, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(h | up)) & full, up & h
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(x | more)) & full, more & x
        if score < best[0]:
            best = (score, j + 1)
    return best


class Index:
    """The items of one block under their keys."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        found = [(i, w) for i, t in items if (w := words_of(t))]
        found.sort(key=lambda x: len(x[1]) < MIN_WORDS)  # the short ones last
        long = [ws for _, ws in found if len(ws) >= MIN_WORDS]
        self.names, self.sizes = [i for i, _ in found], [len(ws) for _, ws in found]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k in range(len(long), len(found)):
            self.short.setdefault(tuple(found[k][1]), []).append(k)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in long for w in ws}), 1)}
        self.items = [[self.vocabulary[w] for w in ws] for ws in long]
        self.sets = [set(ws) for ws in self.items]
        rng, size = np.random.default_rng(SEED), len(self.vocabulary) + 1
        self.walks, had = [], np.zeros(len(self.items), np.int64)
        while self.items and (len(self.walks) < len(REPETITIONS) or had.min() < LEAST_KEYS):
            steps = REPETITIONS[len(self.walks)] if len(self.walks) < len(REPETITIONS) else SHORTEST
            last = len(self.walks) >= MOST
            bits = np.full(size, -1, np.int64) if last else rng.integers(0, 1 << 62, size, dtype=np.int64)
            samples = np.sort(rng.permutation(steps)[:SAMPLES]).tolist()
            keys = self._keys(samples, bits)
            had += np.bincount(keys[1], minlength=len(had))
            self.walks.append((samples, bits, *keys))
            if last:
                break

    def _keys(self, samples: list[int], bits: np.ndarray) -> tuple:
        """Sorted keys with their items and offsets, and which words each sample of an item can have."""
        rows, allowed = [], [np.zeros(len(self.vocabulary) + 1, bool) for _ in samples]
        words = np.array([w for ws in self.items for w in [*ws, 0]], np.int64)  # one word of no item between two items
        sizes = np.array([len(ws) + 1 for ws in self.items])
        item = np.repeat(np.arange(len(sizes)), sizes)
        start, _, met, key = self._walk(words, samples, bits, None)
        inside = (met > 0).all(axis=0)
        for seen, c in zip(allowed, met[:, inside], strict=True):
            seen[c] = True
        start, key = start[inside], key[inside]
        first = np.cumsum(sizes) - sizes
        rows = (key, item[start], start - first[item[start]])
        order = np.argsort(key, kind="stable")
        return tuple(x[order] for x in rows) + (allowed,)

    @staticmethod
    def _walk(ids: np.ndarray, samples: list[int], bits: np.ndarray, allowed: list | None) -> tuple:
        """Windows whose samples stand on enough words: start, place of the last sample, sampled words, key.  allowed: words that each sample may have."""
        moves, start = bits[ids], np.arange(len(ids))
        at, last, seen, key, met = start, np.full(len(ids), -1), np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int64), []
        for j in range(samples[-1] + 1):
            if j in samples:
                c = ids[at]
                if allowed is not None:
                    alive = np.flatnonzero(allowed[samples.index(j)][c])
                    start, at, last, seen, key, c = start[alive], at[alive], last[alive], seen[alive], key[alive], c[alive]
                seen = seen + (at != last)
                last, key = at, key * _MULTIPLY + c
                if allowed is None:
                    met.append(c)
            at = np.minimum(at + (moves[at] >> j & 1), len(ids) - 1)
        enough = np.flatnonzero(seen >= DISTINCT)
        return start[enough], last[enough], np.array(met)[:, enough] if met else None, key[enough]

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (text, where in it the item would begin, item) of the texts that begin at ``starts`` in ``ids``; id 0 stands for a word of no item.

        A window belongs to the text that it stands in, though the item may begin
        before that text; windows that run into the next text are left out.
        """
        out = []
        for samples, bits, keys, items, offsets, allowed in self.walks:
            start, last, _, key = self._walk(ids, samples, bits, allowed)
            text = np.searchsorted(starts, start, "right") - 1
            inside = last < starts[text + 1]
            start, text, key = start[inside], text[inside], key[inside]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            each = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.stack([np.repeat(text[hit], n), np.repeat((start - starts[text])[hit], n) - offsets[each], items[each]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, word after the passage) of each text and item that match, the best passage of each pair."""
        known, rows, starts, at = self.vocabulary.get, [], [0], 0
        for k, t in enumerate(texts):
            words = words_of(t)
            if 0 < len(words) < MIN_WORDS:
                yield from ((k, item, 0, len(words)) for item in self.short.get(tuple(words), ()))
            rows.append([known(w, 0) for w in words])
            at += len(rows[-1]) + 1  # one word of no item between two texts
            starts.append(at)
        if not any(map(any, rows)):
            return
        ids = np.zeros(at, np.int64)
        for row, a in zip(rows, starts, strict=False):
            ids[a : a + len(row)] = row
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, start, item in self.candidates(ids, np.array(starts)).tolist():
            if best.get((k, item), (1,))[0] == 0:
                continue
            ws = self.items[item]
            spare = edits_allowed(len(ws))
            begin = max(0, start - spare)
            passage = rows[k][begin : start + len(ws) + spare]
            if sum(map(self.sets[item].__contains__, passage)) < len(ws) - spare:
                continue
            edits, stop = nearest(ws, passage)
            if edits <= spare and edits < best.get((k, item), (spare + 1,))[0]:
                best[k, item] = (edits, begin + stop)
        yield from ((k, item, *v) for (k, item), v in best.items())


def _build(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of block -> one index file for each block."""

    def done(block: int, items: list) -> pa.RecordBatch:
        uri = new_file(folder, ".index")
        write(uri, pickle.dumps(Index(items)))
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "uri": [uri]})

    block, items = None, []
    for batch in batches:
        for k, item, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text")), strict=True):
            if k != block and items:
                yield done(block, items)
                items = []
            block = k
            items.append((item, text))
    if items:
        yield done(block, items)


def index_files(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[str]:
    """Files with the indexes of all items, each of about ``block_words`` words."""
    spark = benchmark.sparkSession
    items = materialise(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("row", F.monotonically_increasing_id()), "items")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\W_]+")), F.lit(0)) + 1
    # an item goes where the words before it end: a block has block_words words and the rest of one item at most
    placed = running(items.withColumns({"words": words, "all": F.lit(0)}), ["all"], "row", {"upto": F.col("words")})
    placed = placed.withColumn("block", F.floor((F.col("upto") - F.col("words")) / block_words))
    n = placed.agg(F.max("block")).first()[0]
    if n is None:
        return []
    folder = shared_dir(spark, "benchmark-index")
    dealt = placed.select("block", "item_id", "text", "row").repartition(n + 1, "block").sortWithinPartitions("block", "row")
    built = materialise(dealt.mapInArrow(lambda it: _build(it, folder), "block long, uri string"), "index-files")
    return [r["uri"] for r in built.orderBy("block").collect()]


#: The index that a Python worker has read last.
_LOADED: dict[str, Index] = {}


def _load(uri: str) -> Index:
    if uri not in _LOADED:
        _LOADED.clear()
        with Source(uri) as source:
            _LOADED[uri] = pickle.loads(source.range(0, source.size()))
    return _LOADED[uri]


SLICE = 200


def find_matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word for every document and item that match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema, out = "doc_id long, item_id long, edits long, item_words long, end_word long", None
    for uri in index_files(benchmark, block_words):

        def run(batches: Iterator[pa.RecordBatch], uri=uri) -> Iterator[pa.RecordBatch]:
            index = _load(uri)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    names = batch.column("doc_id").slice(at, SLICE).to_pylist()
                    got = [(names[k], index.names[i], edits, index.sizes[i], stop) for k, i, edits, stop in index.matches(batch.column("text").slice(at, SLICE).to_pylist())]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], ["doc_id", "item_id", "edits", "item_words", "end_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that match no item, with unchanged columns.

    Each block is a pass of its own, with one index in memory a worker; what is gathered
    are the marks (md5) of the texts that match, which then leave ``docs`` by one anti join.
    """
    mark, found = "_mark" + "_" * max(map(len, docs.columns)), None
    rows = docs.select(F.md5("text").alias(mark), "text")
    for uri in index_files(benchmark, block_words):

        def run(batches: Iterator[pa.RecordBatch], uri=uri) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    some = batch.slice(at, SLICE)
                    hit = sorted({m[0] for m in _load(uri).matches(some.column("text").to_pylist())})
                    if hit:
                        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(hit))], [mark])

        part = rows.mapInArrow(run, f"{mark} string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs
    found = materialise(found.distinct(), "contaminated")
    return small_or_shuffled(docs.withColumn(mark, F.md5("text")), found, mark, "left_anti").drop(mark)


def op9_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_matches(spread(docs.select("doc_id", "text")), benchmark)
