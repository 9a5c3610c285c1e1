"""Operator 2, embedding near-duplicates: lattice hashing.

Each table of the index projects a unit vector to eight dimensions (or several
times eight) and decodes every eight to the nearest point of the E8 lattice.  A
vector is filed under its own cell and asks its own cell and the neighbouring
ones (the nearest of the 240 shortest lattice steps).  Pairs that meet and whose
sign sketches are not too far apart are verified by cosine in double precision, so
no link is below the threshold; equal vectors are folded into one group first, so
copies never become pairs.

Cells that many vectors share are divided by a salt before they are joined.  A
pair is verified in one of the cells where it met: the cell gets each vector of
its pairs once, and cells with very many pairs are divided further.  The number
of lattices to a key grows with the number of vectors, so that chance meetings
for each vector stay few.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing; vectors of different
length do not link; components of any finite size count (they are scaled first);
repeated rows count as vectors of their own, each a link of the others; rows are
told apart by their vectors, so an id that stands on several vectors has a row, with
links of its own, for each; component ids are the smallest id of the component, null
if none has an id; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, materialise
from .components import components

#: Lattices to a key -> tables.  More lattices part unrelated vectors better and need more tables for the same recall.
TABLES = {1: 7, 2: 36, 3: 160}
PROBES, SCALE, SEED = 4, 0.85, 20_240_501
#: Share of unrelated vectors that meet in one key of one lattice, about; chance meetings that a vector may have.
MEET, CHANCE = 1.5e-4, 400.0
#: Bits of two sign sketches that may differ: for vectors at the threshold they do in 1 of 10,000.
SKETCH_BITS = 19
#: Vectors of a cell in one salt; pairs of a cell that are verified together.
CELL, PAIRS = 5_000, 4_000
#: Pairs whose vectors are laid side by side.
PAIRS_AT_ONCE = 1_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@cache
def e8_steps() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two entries +-1, or eight entries +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with an even sum: round, and where the sum is odd re-round the worst entry."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - y[odd]
        worst = np.abs(gap).argmax(axis=1)
        y[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of the two decodings."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _cell_ids(points: np.ndarray) -> np.ndarray:
    """Eight doubled coordinates as eight bytes of one long."""
    return np.ascontiguousarray(np.rint(points * 2).astype(np.int8)).view(np.int64).reshape(points.shape[:-1])


@cache
def _directions(*seed: int, width: int = 8) -> np.ndarray:
    """Random projections of vectors of seed[0] components."""
    return np.random.default_rng([SEED, *seed]).standard_normal((seed[0], width))


def _mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    h = (h ^ by) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component before, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(vectors: np.ndarray, table: int, lattices: int = 1, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The home key of unit vectors in one table, and the keys that they ask, home first: neighbours of one lattice at a time."""
    homes, near = [], []
    for k in range(lattices):
        x = vectors @ _directions(vectors.shape[1], table, k) * scale
        y, steps = nearest_e8(x), e8_steps()
        homes.append(_cell_ids(y).view(np.uint64))
        if probes:
            best = np.argpartition(-((x - y) @ steps.T), probes, axis=1)[:, :probes]
            near.append(_cell_ids(y[:, None, :] + steps[best]).view(np.uint64))

    def key(at: int | None, cells: np.ndarray | None) -> np.ndarray:
        h = np.full((len(vectors), 1), table + 1, np.uint64)
        for k, home in enumerate(homes):
            h = _mixed(h, cells if k == at else home[:, None])
        return h

    own = key(None, None)
    return own[:, 0], np.concatenate([own, *(key(k, cells) for k, cells in enumerate(near))], axis=1)


def sketch(vectors: np.ndarray) -> np.ndarray:
    """64 signs of random projections as one long."""
    signs = vectors @ _directions(vectors.shape[1], width=64) > 0
    return np.packbits(signs, axis=1).view(np.int64)[:, 0]


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of the rows of each length."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def _file(batches: Iterator[pa.RecordBatch], lattices: int, tables: int, probes: int, home: bool) -> Iterator[pa.RecordBatch]:
    """key, gid, sketch: the home keys of all vectors, or the keys that they ask."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            ids, marks = some.column("gid").to_numpy(), some.column("grp").to_numpy().view(np.uint64)
            for rows, x in _by_length(some.column("embedding")):
                x = unit(x)
                signs = sketch(x)
                for t in range(tables):
                    own, asked = cells_of(x, t, lattices, 0 if home else probes)
                    keys = _mixed(own[:, None] if home else asked, marks[rows][:, None])
                    k = keys.shape[1]
                    yield pa.record_batch({"key": keys.ravel().view(np.int64), "gid": np.repeat(ids[rows], k), "sketch": np.repeat(signs, k)})


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links join two parts that earlier links of the list left apart."""
    root = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out[k] = True
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: first the vectors of a block, then its pairs.  Gives the links."""
    block, gids, marks, counts, vectors = None, [], [], [], []
    ready = None

    def gather() -> tuple:
        lists = pa.chunked_array(vectors).combine_chunks()
        parts = [(rows, unit(xs)) for rows, xs in _by_length(lists)]
        # a block has one length but where keys collide; zeros after a shorter vector change no cosine
        x = np.zeros((len(lists), max(xs.shape[1] for _, xs in parts)))
        for rows, xs in parts:
            x[rows, : xs.shape[1]] = xs
        return np.concatenate(gids), np.concatenate(marks), np.concatenate(counts), x

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, grp, n, x = ready
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        same = grp[i] == grp[j]
        i, j = i[same], j[same]
        cos = np.empty(len(i))
        for at in range(0, len(i), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            cos[some] = np.einsum("ij,ij->i", x[i[some]], x[j[some]])
        near = cos >= threshold
        i, j = i[near], j[near]
        return pa.record_batch({"a": ids[i], "b": ids[j], "similarity": cos[near], "na": n[i], "nb": n[j], "tree": _forest(i, j)})

    for batch in batches:
        blk, kind = batch.column("blk").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(blk) | np.diff(kind)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(blk)], strict=True):
            if hi == lo:
                continue
            some = batch.slice(lo, hi - lo)
            if block is None or blk[lo] != block:
                block, gids, marks, counts, vectors, ready = blk[lo], [], [], [], [], None
            if kind[lo] == 0:
                gids.append(some.column("a").to_numpy())
                marks.append(some.column("grp").to_numpy())
                counts.append(some.column("n").to_numpy())
                vectors.append(some.column("embedding"))
            else:
                ready = ready or gather()
                out = links(some.column("a").to_numpy(), some.column("b").to_numpy())
                if out.num_rows:
                    yield out


def lattices_for(vectors: int, probes: int = PROBES) -> int:
    """Lattices to a key so that a vector meets about CHANCE of so many unrelated ones at most."""
    for k in TABLES:
        if vectors * TABLES[k] * (1 + 2 * k * probes) * MEET**k <= CHANCE:
            return k
    return max(TABLES)


def _salted(homes: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with more than CELL homes are divided by a salt; those who ask there ask in every salt."""
    hot = materialise(homes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("salts")), "hot")
    n = hot.count()
    if not n:
        return homes.withColumn("salt", F.lit(0)), asks.withColumn("salt", F.lit(0))
    hot = F.broadcast(hot) if n <= SMALL else hot
    salts = F.coalesce("salts", F.lit(1))
    homes = homes.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("gid"), salts).cast("int")).drop("salts")
    return homes, asks.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def _blocks(pairs: DataFrame) -> DataFrame:
    """blk, a, b: the block in which each pair (a, b, key) is verified, a part of its cell if that has very many pairs."""
    crowded = materialise(pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS).select("key", F.ceil(F.sqrt(F.col("n") / PAIRS)).cast("int").alias("parts")), "crowded")
    n = crowded.count()
    if not n:
        return pairs.select(F.col("key").alias("blk"), "a", "b")
    part: dict[str, Column] = {k: F.pmod(F.xxhash64(F.lit(5), k), F.col("parts")) for k in "ab"}
    found = pairs.join(F.broadcast(crowded) if n <= SMALL else crowded, "key", "left")
    return found.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part["a"], part["b"])).alias("blk"), "a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, lattices: int | None = None, tables: int | None = None, probes: int = PROBES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors: vec_id, embedding, label.  Returns rows with their group key, groups and links between groups.

    rows: vec_id, k1, k2, valid.  groups: gid, first_id (smallest vec_id), n, k1, k2.
    links: a, b (gids, a < b), similarity, na, nb (rows of a and b), tree (the links
    marked so connect what all links connect).  The sketch allows for a threshold of
    0.9 or more.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("valid", F.coalesce(valid, F.lit(False)))
    rows = rows.select("*", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(17), "embedding", "label").alias("k2"))
    groups = rows.filter("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    groups = materialise(groups.select(F.monotonically_increasing_id().alias("gid"), "first_id", "n", "k1", "k2", F.xxhash64("label", F.size("embedding")).alias("grp"), "embedding"), "vectors")
    if lattices is None:
        lattices = lattices_for(groups.groupBy("grp").count().agg(F.max("count")).first()[0] or 0)
    tables = tables or TABLES[lattices]

    def filed(home: bool) -> DataFrame:
        return groups.select("gid", "grp", "embedding").mapInArrow(lambda it: _file(it, lattices, tables, probes, home), "key long, gid long, sketch long")

    homes, asks = _salted(materialise(filed(True), "homes"), filed(False))
    met = asks.join(homes.select("key", "salt", F.col("gid").alias("other"), F.col("sketch").alias("other_sketch")), ["key", "salt"])
    met = met.filter((F.col("gid") != F.col("other")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("other_sketch"))) <= SKETCH_BITS))
    pairs = met.groupBy(F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b")).agg(F.min("key").alias("key"))
    pairs = _blocks(materialise(pairs, "pairs"))
    ends = pairs.select("blk", F.explode(F.array("a", "b")).alias("gid")).distinct()
    kind, none = F.lit(0).alias("kind"), F.lit(None).cast("long")
    members = ends.join(groups.select("gid", "grp", "n", "embedding"), "gid").select("blk", kind, F.col("gid").alias("a"), none.alias("b"), "grp", "n", "embedding")
    asked = pairs.select("blk", F.lit(1).alias("kind"), "a", "b", none.alias("grp"), none.alias("n"), F.lit(None).cast(groups.schema["embedding"].dataType).alias("embedding"))
    sorted_blocks = members.unionByName(asked).repartition("blk").sortWithinPartitions("blk", "kind", "a")
    links = materialise(sorted_blocks.mapInArrow(lambda it: _verify(it, threshold), "a long, b long, similarity double, na long, nb long, tree boolean"), "links")
    return rows, groups.drop("embedding", "grp"), links


def op2_lattice_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, groups, links = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    comps = components(links.filter("tree")).withColumnRenamed("id", "gid")
    degree = links.select(F.col("a").alias("gid"), F.col("nb").alias("m")).unionByName(links.select(F.col("b").alias("gid"), F.col("na").alias("m"))).groupBy("gid").agg(F.sum("m").alias("linked"))
    found = groups.join(degree, "gid", "left").join(comps, "gid", "left")
    found = found.select("k1", "k2", "first_id", F.col("comp"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    lowest = found.filter("comp is not null").groupBy("comp").agg(F.min("first_id").alias("lowest"))
    per_group = found.join(lowest, "comp", "left").select("k1", "k2", "n_links", F.when(F.col("comp").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("comp"))
    out = rows.select("vec_id", "k1", "k2", "valid").join(per_group, ["k1", "k2"], "left")
    comp = F.when(F.col("valid"), F.col("comp")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
