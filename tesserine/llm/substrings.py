"""Operator 11, substring dedup: seed and extend.

A repeat is a run of LENGTH words or more that also stands in a document with a
smaller id.  Seeds: of every LENGTH - SEED + 1 neighbouring runs of SEED words the one
with the smallest hash is an anchor (winnowing), so each window of LENGTH words has
exactly one anchor, which hangs on the words of the window alone: two equal windows have
equal anchors at equal places.

1. Anchors are joined by an aggregation: those of one document only are dropped.
2. Each anchor that is left is extended both ways at once as far as any window with it can
   reach (LENGTH - SEED words each way).  Places with equal extensions are one class; in all of
   its documents but the first, all windows around the anchor repeat.
3. The first document of each class is left, and only where the anchor has several classes: there
   the match ends within reach.  It is extended by every split of those words between left
   and right, and a window is a repeat where an equal one has a smaller document.
4. Overlapping repeats are merged: what is left are the maximal ones.

All groupings are minima, which combine before the shuffle, so a group of copies
of any size is one row a task; no pairs within a group are made.  Runs are
compared by two independent 64-bit hashes (anchor, and extension or window).

Defined results: a null or blank text has no words, one of fewer than LENGTH words no
window; repeats within one document count for nothing; rows of the same id (repeated rows
too) do not remove each other's words; a null id counts as the largest of all; words are bytes
between ASCII white space and of any length; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import spread

from .common import clearing, materialise, table

LENGTH, SEED = 13, 5
REACH = LENGTH - SEED
#: All windows around an anchor.
WHOLE = (1 << (REACH + 1)) - 1
#: Documents of one Arrow batch that leaves a task.
ROWS = 200
#: Two families of odd multipliers: one for anchors, one for extensions and windows.
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LAST = 2**63 - 1


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


class Powers:
    """Powers of a multiplier and of its inverse modulo 2^64, as many as the longest piece of text has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            by = int(_ONE) | 1
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, x % 2**64, np.uint64))) for x in (by, pow(by, -1, 2**64)))


#: Bytes of text whose sums are held at once; a longer word is one piece.
PIECE = 1 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def hashed(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, one after the other, and the number of its text.

    A word's hash is the polynomial of its bytes, taken from running sums over the
    text: no word is a Python object.
    """
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, at, data = raw.buffers()
    edge = np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    blank = _BLANK[data]
    starts, stops = ~blank, ~blank
    starts[1:] &= blank[:-1]
    stops[:-1] &= blank[1:]
    first, last = edge[:-1][edge[:-1] < len(data)], edge[1:][edge[1:] > 0] - 1
    starts[first], stops[last] = ~blank[first], ~blank[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    out, k = np.empty(len(begin), np.uint64), 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + PIECE)))
        base, size = begin[k], int(end[stop - 1] - begin[k])
        powers.grow(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * powers.up[:size], out=sums[1:])
        b, e = begin[k:stop] - base, end[k:stop] - base
        h = (sums[e] - sums[b]) * powers.down[b]
        out[k:stop] = (h ^ (h >> np.uint64(32))) * _TWO
        k = stop
    return out, np.searchsorted(edge, begin, "right") - 1


def _runs(w: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(w) - size + 1)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : n + i]) * by
        h ^= h >> np.uint64(29)
    return h


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all seeds, and where the anchor of each window begins: the first of its smallest seeds."""
    seeds = _runs(w, SEED, _ONE)
    if len(w) < LENGTH:
        return seeds, np.zeros(0, np.int64)
    low, where, wide = seeds, np.arange(len(seeds)), 1
    while wide < REACH + 1:
        by = min(wide, REACH + 1 - wide)
        left = low[:-by] <= low[by:]
        low, where, wide = np.where(left, low[:-by], low[by:]), np.where(left, where[:-by], where[by:]), wide + by
    return seeds, where


def _extensions(w: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the anchors with all words in reach; beyond the ends of a document stands a word of its own."""
    h = np.full(len(at), LENGTH, np.uint64)
    own = doc[at]
    for i in range(-REACH, SEED + REACH):
        near = np.clip(at + i, 0, len(w) - 1)
        inside = (doc[near] == own) & (near == at + i)
        h = (h ^ np.where(inside, w[near], np.uint64(0))) * _TWO
        h ^= h >> np.uint64(31)
    return h


def _located(part: pa.RecordBatch, powers: Powers) -> tuple[np.ndarray, ...]:
    """Word hashes, their documents, all seeds, and begin and anchor of each window that is one document's."""
    w, doc = hashed(part.column("text"), powers)
    seeds, chosen = anchors(w)
    begin = np.flatnonzero(doc[: len(chosen)] == doc[LENGTH - 1 :][: len(chosen)])
    return w, doc, seeds, begin, chosen[begin]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor of each document once, with its extension and place."""
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            w, doc, seeds, _, chosen = _located(part, powers)
            chosen = chosen[np.diff(chosen, prepend=-1) > 0]  # in order: neighbouring windows have the same anchor or a later one
            who = doc[chosen]
            first = np.searchsorted(doc, who)
            row = [part.column(c).take(pa.array(who)) for c in ("doc", "sig")]
            hashes = [pa.array(x.view(np.int64)) for x in (seeds[chosen], _extensions(w, doc, chosen))]
            yield pa.RecordBatch.from_arrays([*hashes, *row, pa.array(chosen - first, pa.int32())], ["anchor", "ext", "doc", "sig", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the anchors at the places ``pos`` of each document: how far each begins from its anchor (``shift``)."""
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            w, doc, seeds, begin, chosen = _located(part, powers)
            wanted = part.column("pos")
            who = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            asked = np.zeros(len(w) + 1, bool)
            asked[np.searchsorted(doc, who) + wanted.flatten().to_numpy()] = True
            keep = asked[chosen]
            begin, chosen = begin[keep], chosen[keep]
            hashes = [pa.array(x.view(np.int64)) for x in (seeds[chosen], _extensions(w, doc, chosen), _runs(w, LENGTH, _TWO)[begin])]
            yield pa.RecordBatch.from_arrays([*hashes, part.column("doc").take(pa.array(doc[begin])), pa.array(begin - chosen, pa.int32())], ["anchor", "ext", "window", "doc", "shift"])


def maximal(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans merged where they overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and the maximal repeats that went."""
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            total, gone, kept, cut = [], [], [], []
            for t, found in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                w = split(t)
                if not found:
                    total.append(len(w))
                    gone.append(0)
                    kept.append(b" ".join(w))
                    cut.append([])
                    continue
                pos, mask = np.array([(x["pos"], x["mask"]) for x in found], np.int64).T
                begin = np.concatenate([pos[mask >> i & 1 == 1] - i for i in range(REACH + 1)])
                begin = begin[(begin >= 0) & (begin <= len(w) - LENGTH)]
                begin, end = maximal(begin, begin + LENGTH)
                left, last = [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    left += w[last:b]
                    last = e
                left += w[last:]
                total.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left))
                cut.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cut, spans)], ["doc_id", "n_words", "n_removed", "kept", "repeats"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc (the id, LAST for none), sig (hash of the text), text -> doc, sig, spans: repeated windows around anchors, not yet merged.

    A span is the place of an anchor and a mask: bit i stands for the window that begins i words before it.

    To be called inside ``clearing``.
    """
    places = docs.mapInArrow(_seeds, "anchor long, ext long, doc long, sig long, pos int")
    shared = places.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("anchor", "first")
    met = materialise(places.join(materialise(shared, "anchors"), "anchor"), "seeds")
    leads = met.groupBy("anchor", "ext").agg(F.min(F.struct("doc", "sig", "pos")).alias("lead"), F.first("first").alias("first"))
    leads = materialise(leads.select("anchor", "ext", "first", "lead.*"), "classes")

    # where a match ends within reach
    several = materialise(leads.groupBy("anchor").agg(F.max(F.col("doc") > F.col("first")).alias("more")).filter("more").select("anchor"), "several")
    ends = leads.join(several, "anchor", "left_semi").groupBy("doc", "sig").agg(F.collect_set("pos").alias("pos"))
    windows = docs.join(materialise(ends, "ends"), ["doc", "sig"]).select("doc", "text", "pos")
    windows = materialise(windows.mapInArrow(_windows, "anchor long, ext long, window long, doc long, shift int"), "windows")
    lowest = materialise(windows.groupBy("anchor", "window").agg(F.min("doc").alias("lowest")), "lowest")
    parts = windows.join(lowest, ["anchor", "window"]).filter("doc > lowest").groupBy("anchor", "ext").agg(F.bit_or(F.expr("shiftleft(1, -shift)")).alias("part"))

    # every place of a class behind its first document is a repeat as far as it reaches, the others by windows
    leads = materialise(leads.select("anchor", "ext", F.col("doc").alias("lead")).join(parts, ["anchor", "ext"], "left"), "extended")
    found = met.join(leads, ["anchor", "ext"]).filter("doc > lead or part is not null")
    mask = F.when(F.col("doc") > F.col("lead"), F.lit(WHOLE)).otherwise(F.col("part"))
    return found.select("doc", "sig", "pos", mask.alias("mask")).groupBy("doc", "sig").agg(F.collect_list(F.struct("pos", "mask")).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept (the words that stay, joined by blanks), repeats (begin, end in words)."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = marked.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "sig": F.xxhash64("text")})
    with clearing(docs.sparkSession):
        spans = materialise(repeats(marked.select("doc", "sig", "text")), "spans", keep=True)
    return marked.join(spans, ["doc", "sig"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<begin:int,end:int>>")


def op11_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from w where len(w) >= 13) x),
f as (select g, min(doc_id) as first from s group by g having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from s join f on f.g = s.g and f.first < s.doc_id),
a as (select doc_id, list(i) as gone from c group by doc_id)
select w.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(list_transform(generate_series(1, len(w)), lambda i: case when not list_contains(gone, i) then w[i] end), lambda x: x is not null) end, ' ')) as kept_sha256
from w left join a on a.doc_id = w.doc_id
"""
