"""Nearest neighbours by an index: cells around centroids, one byte a dimension, exact scores at the end.

``build`` puts every vector into the cell of its nearest centroid and keeps beside it
what is left of it after the centroid, in steps of a byte.  The files are laid out by cell, so a
query reads the cells that it probes and of these only the bytes; the best KEEP of a query are
then scored exactly with their whole vectors.  ``tune`` finds how many cells have to be probed for
a recall that is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import vectors as V
from tesserine.sinks import stored

#: Vectors that the centroids are fitted on, centroids at most, queries answered in one pass, and those that ``tune`` tries.
SAMPLE, CELLS, QUERIES, TRIED = 20_000, 1_024, 2_048, 200
#: Candidates of a query that are scored exactly, for each hit that is wanted.
KEEP = 10
#: Rows of a scan that are compared with a block of queries at once, and pairs whose cosines are taken at once.
CHUNK, PAIRS = 1_024, 100_000
LAYOUT = "cell int, id long, code binary, scale float, embedding array<float>"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """id, embedding of the rows that have a cosine: the right length, all numbers finite, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("id").isNotNull() & F.coalesce((F.size("embedding") == size) & finite, F.lit(False))).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


class Index:
    """Vectors by cell, in files, with the centroids (at most CELLS) at hand."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        self.rows, self.centroids = rows, centroids

    def cells_of(self, queries: np.ndarray, probes: int) -> np.ndarray:
        near = _unit(queries) @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def fit(vectors: DataFrame, size: int, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of a bounded sample, the vectors with the smallest hashes of their ids."""
    some = usable(vectors, size).orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("embedding").alias("features")).coalesce(1).cache()
    n = some.count()
    cells = min(cells or min(CELLS, math.isqrt(max(n, 1))), max(n, 1))
    found = KMeans(k=cells, seed=1, distanceMeasure="cosine", maxIter=15).fit(some).clusterCenters() if cells > 1 else [np.eye(1, size)[0]]
    some.unpersist()
    return _unit(np.array(found))


def build(vectors: DataFrame, folder: str, size: int, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of id, embedding in ``folder``; rows without a cosine are left out.

    Rows are dealt by cell and hash of the id, in ranges of like size: a crowded cell is many files.
    """
    centroids = fit(vectors, size, cells, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64))
                cell = (rows @ centroids.T).argmax(1)
                rest = rows - centroids[cell]
                scale = np.maximum(np.abs(rest).max(1) / 127, 1e-30).astype(np.float32)
                code = np.rint(rest / scale[:, None]).clip(-127, 127).astype(np.int8)
                codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(np.arange(0, code.size + 1, size, dtype=np.int32)), pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), codes, pa.array(scale), batch.column("embedding")], ["cell", "id", "code", "scale", "embedding"])

    rows = usable(vectors, size).mapInArrow(assign, LAYOUT)
    rows.repartitionByRange(F.col("cell"), F.xxhash64("id")).write.partitionBy("cell").option("maxRecordsPerFile", 1_000_000).mode("overwrite").parquet(folder)
    return Index(vectors.sparkSession.read.schema(LAYOUT).parquet(folder), centroids)


def _candidates(index: Index, ids: list[int], queries: np.ndarray, probed: np.ndarray, keep: int) -> DataFrame:
    """q, id, cell: for each query the best ``keep`` by its bytes, of every task; a task holds no more for a query."""
    size, centroids = queries.shape[1], index.centroids
    unit = _unit(queries)
    wants = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, size)
            scale, row = batch.column("scale").to_numpy(), batch.column("id").to_numpy()
            for c in np.unique(cell):
                here = np.flatnonzero(cell == c)
                who = wants[int(c)]
                near = (unit[who] @ centroids[c])[:, None] + (unit[who].astype(np.float32) @ code[here].T.astype(np.float32)) * scale[here]
                for q, s in zip(who.tolist(), near, strict=True):
                    was = best.get(q, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)))
                    s, i, k = np.append(was[0], s), np.append(was[1], row[here]), np.append(was[2], np.full(len(here), c, np.int32))
                    top = np.argpartition(-s, keep - 1)[:keep] if len(s) > keep else slice(None)
                    best[q] = s[top], i[top], k[top]
        for q, (s, i, k) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(s), pa.int64()), pa.array(i), pa.array(k, pa.int32()), pa.array(s, pa.float64())], ["q", "id", "cell", "near"])

    narrow = index.rows.filter(F.col("cell").isin([int(c) for c in wants])).select("cell", "id", "code", "scale")
    rough = narrow.mapInArrow(scan, "q long, id long, cell int, near double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    return rough.withColumn("nth", nth).filter(F.col("nth") <= keep).select("q", "id", "cell")


Queries = Sequence[tuple[int, Sequence[float]]] | DataFrame


def _in_blocks(queries: Queries) -> Iterator[list[tuple[int, list[float]]]]:
    """Queries (id, vector) a block at a time; of a table (id, embedding) no more than a block of about QUERIES is on the driver at once."""
    if not isinstance(queries, DataFrame):
        rows = list(queries)
        yield from (rows[at : at + QUERIES] for at in range(0, len(rows), QUERIES))
        return
    n = -(-queries.count() // QUERIES)
    for k in range(n):
        some = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).select("id", "embedding").orderBy("id")
        if rows := [(r["id"], r["embedding"]) for r in some.collect()]:
            yield rows


def _asked(spark: SparkSession, block: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in block], "q long, query array<double>")


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= limit).select(F.col("q").alias("query"), "rank", "id", "score")


def _all(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


HITS = "query long, rank int, id long, score double"


def search(index: Index, queries: Queries, limit: int, probes: int, keep: int = KEEP) -> DataFrame:
    """query, rank, id, score: the ``limit`` nearest of each query by cosine, ties by id.

    Queries are answered a block in one pass over the cells that any of them probes.
    """
    spark, parts = index.rows.sparkSession, []
    for block in _in_blocks(queries):
        asked = np.array([v for _, v in block], np.float64)
        probed = index.cells_of(asked, probes)
        rough = _candidates(index, [i for i, _ in block], asked, probed, keep * limit)
        whole = index.rows.filter(F.col("cell").isin(sorted({int(c) for c in probed.ravel()}))).select("cell", "id", "embedding")
        # a block's queries times keep times limit pairs at most
        scored = whole.join(F.broadcast(rough), ["cell", "id"]).join(F.broadcast(_asked(spark, block)), "q").withColumn("score", V.cosine(F.col("embedding"), F.col("query")))
        parts.append(_ranked(scored, limit))
    return _all(parts, spark, HITS)


def _cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The cosines of rows and queries, one beside the other, added up in the order of ``V.cosine``: equal rows have equal scores wherever they stand."""
    s = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        s += rows[:, d] * query[:, d]
    return s / (lengths * length)


def _lengths(rows: np.ndarray) -> np.ndarray:
    s = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        s += rows[:, d] * rows[:, d]
    return np.sqrt(s)


def _scan(vectors: DataFrame, block: list[tuple[int, list[float]]], limit: int) -> DataFrame:
    """q, id, score: the ``limit`` nearest of a block's queries in every task; a task holds no more for a query.

    A product of matrices tells which rows can be among a query's nearest; only
    these get their cosine.
    """
    ids, queries = np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64)
    size, length = queries.shape[1], _lengths(queries)
    unit = queries / np.maximum(length, 1e-300)[:, None]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        reach = np.full(len(ids), -np.inf)
        for batch in batches:
            all_ids = batch.column("id").to_numpy()
            whole = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            for at in range(0, len(whole), CHUNK):
                some, key = whole[at : at + CHUNK], all_ids[at : at + CHUNK]
                lengths = _lengths(some)
                near = unit @ (some / np.maximum(lengths, 1e-300)[:, None]).T
                least = reach
                if len(some) > limit and np.isinf(reach).any():
                    least = np.maximum(reach, np.partition(near, len(some) - limit, axis=1)[:, len(some) - limit])
                # the product's own error is far below this
                q, r = np.nonzero(near >= (least - 1e-9)[:, None])
                if len(q):
                    found = np.concatenate([_cosines(some[r[k : k + PAIRS]], lengths[r[k : k + PAIRS]], queries[q[k : k + PAIRS]], length[q[k : k + PAIRS]]) for k in range(0, len(q), PAIRS)])
                    which, row, score = np.append(which, q), np.append(row, key[r]), np.append(score, found)
                    order = np.lexsort((row, -score, which))
                    which, row, score = which[order], row[order], score[order]
                    first = np.searchsorted(which, which)
                    top = np.arange(len(which)) - first < limit
                    which, row, score = which[top], row[top], score[top]
                    last = np.flatnonzero(np.bincount(which, minlength=len(ids)) == limit)
                    reach[last] = score[np.searchsorted(which, last, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(row), pa.array(score)], ["q", "id", "score"])

    return vectors.select("id", "embedding").mapInArrow(scan, "q long, id long, score double")


def exact(vectors: DataFrame, queries: Queries, limit: int) -> DataFrame:
    """The same by a scan of all vectors (id, embedding; as ``usable`` gives them) for a stated set of queries, a block at a time."""
    return _all([_ranked(_scan(vectors, block, limit), limit) for block in _in_blocks(queries)], vectors.sparkSession, HITS)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted hits (query, id) that were found."""
    wanted = stored(wanted.select("query", "id"), "wanted")
    n = wanted.count()
    return wanted.join(found, ["query", "id"], "left_semi").count() / n if n else 1.0


def tune(index: Index, limit: int, target: float, tried: int = TRIED) -> int:
    """The fewest cells to probe for a recall of ``target``, measured on ``tried`` indexed vectors as queries.

    One scan for the exact hits of these queries tells in how many cells, by nearness, each hit lies.
    """
    some = [(r["id"], r["embedding"]) for r in index.rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(tried).collect()]
    if not some:
        return 1
    order = index.cells_of(np.array([v for _, v in some]), len(index.centroids))
    place = {(i, int(c)): n + 1 for (i, _), row in zip(some, order, strict=True) for n, c in enumerate(row)}
    hits = exact(index.rows.select("id", "embedding"), some, limit).join(index.rows.select("id", "cell"), "id").select("query", "cell").collect()
    needed = sorted(place[h["query"], h["cell"]] for h in hits)
    return needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]


def read_share(index: Index, queries: Queries, limit: int, probes: int, keep: int = KEEP) -> DataFrame:
    """query, rows, scanned, bytes_share: what each query reads, against the bytes of all vectors.

    A scanned row is its bytes, id and scale; a candidate its whole vector besides.
    """
    spark, size, probed = index.rows.sparkSession, index.centroids.shape[1], []
    for block in _in_blocks(queries):
        order = index.cells_of(np.array([v for _, v in block], np.float64), probes)
        probed.append(spark.createDataFrame([(i, [int(c) for c in row]) for (i, _), row in zip(block, order, strict=True)], "query long, cells array<int>"))
    each = _all(probed, spark, "query long, cells array<int>").select("query", F.explode("cells").alias("cell"))
    cells = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("rows"))
    scanned = each.join(cells, "cell").groupBy("query").agg(F.sum("n").alias("scanned"))
    read = F.col("scanned") * (size + 12) + F.least(F.lit(keep * limit), F.col("scanned")) * 4 * size
    return scanned.join(F.broadcast(total)).select("query", "rows", "scanned", F.round(read / (F.col("rows") * (4 * size + 8)), 4).alias("bytes_share"))
