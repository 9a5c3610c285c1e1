"""Operator 4, quality classifier: regularised quadratic discriminant analysis.

Each text is reduced to a few transformed statistics of its characters, words
and lines.  Per class the mean and a covariance shrunk towards its scaled
identity are fitted from sums that Spark adds up over a sample of about FIT_ROWS
labelled rows of the training folds (all of them, if there are fewer).  A score is the logistic of the difference of the two Gaussian
log densities, whose Mahalanobis terms use Cholesky factors computed once.

Defined results: a null text counts as empty; an empty text has all-zero
statistics and a score like any other; repeated rows get equal scores; of several
labels of a document the highest counts; a null id has no label; a score of exactly
CUT is predicted 1; without labels of both classes every score is 0.5; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.session import spread

from .common import SMALL, fold, materialise

FOLDS, SHRINK, CUT, CLIP = 5, 0.05, 0.3, 6.0
FEATURES = 18
#: Labelled rows that the discriminant is fitted on, about.
FIT_ROWS = 50_000

_SETS = [bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\n\v\f\r", b".,;:?'\"-()", b"!", b"|<>{}[]\\/=_~^", b"#$%&*@+`"]


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; all zero if it is empty."""
    raw = text.encode()
    if not raw:
        return [0.0] * FEATURES
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit, space, mild, bang, frame, symbol = (seen[np.frombuffer(s, np.uint8)].sum() for s in _SETS)
    high = seen[0xC0:].sum()
    size = len(raw) - seen[0x80:0xC0].sum()
    letters = max(1, lower + upper + high)
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    part = seen[seen > 0] / len(raw)
    return [
        float(np.log1p(len(words))),
        float(np.log1p((size - space) / n)),
        letters / size,
        float(np.sqrt(upper / letters)),
        float(np.sqrt(digit / size)),
        float(np.sqrt(mild / size)),
        float(np.sqrt(bang / size)),
        float(np.sqrt(frame / size)),
        float(np.sqrt(symbol / size)),
        float(np.sqrt(high / letters)),
        float(np.log1p(len(counts)) / np.log1p(n)),
        float(np.sqrt(max(counts.values(), default=0) / n)),
        float(np.sqrt(sum(map(eq, words, words[1:])) / n)),
        len(set(zip(words, words[1:], strict=False))) / n,
        float(np.log1p(len(lines))),
        float(np.log1p(size / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(-(part * np.log2(part)).sum()),
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            rows = [statistics(t or "") for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*some.schema.names[:-1], "stats"])


def describe(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and stats, an array of doubles."""
    rows = docs.select(*keep, "text")
    schema = rows.drop("text").schema.add("stats", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_describe, schema)


class Discriminant:
    """Two Gaussians over clipped, standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float):
        self.centre, self.scale, self.ready = centre, scale, all(sums.get(k, (0,))[0] > 1 for k in (0, 1))
        if not self.ready:
            return
        total, self.parts = sums[0][0] + sums[1][0], []
        for k in (0, 1):
            n, first, second = sums[k]
            mean = first / n
            cov = second / n - np.outer(mean, mean)
            cov = (1 - shrink) * cov + (shrink * max(np.trace(cov) / len(mean), 0.0) + 1e-6) * np.eye(len(mean))
            root = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(root).T, np.log(n / total) - np.log(np.diag(root)).sum()))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        z = self.standard(x)
        low, high = (const - 0.5 * (((z - mean) @ white) ** 2).sum(axis=1) for mean, white, const in self.parts)
        return 1 / (1 + np.exp(-np.clip(high - low, -500, 500)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(train: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """train: stats, label (0 or 1).  Two passes of sums over all its rows; the driver gets a few hundred numbers."""
    at = F.posexplode("stats").alias("at", "v")
    moments = train.select(at).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("at").collect()
    centre = np.array([r["mean"] for r in moments]) if moments else np.zeros(FEATURES)
    scale = np.maximum(np.array([r["sd"] for r in moments]) if moments else np.ones(FEATURES), 1e-6)
    model = Discriminant(centre, scale, {}, shrink)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y = model.standard(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = z[y == k]
                held[k] = held.get(k, 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k, v in held.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(v), pa.int32()), "at": pa.array(np.arange(len(v)), pa.int32()), "v": v})

    added = train.mapInArrow(partial, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).orderBy("label", "at").collect()
    sums = {}
    for k in (0, 1):
        v = np.array([r["v"] for r in added if r["label"] == k])
        if len(v):
            sums[k] = (v[0], v[1 : FEATURES + 1], v[FEATURES + 1 :].reshape(FEATURES, FEATURES))
    return Discriminant(centre, scale, sums, shrink)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """``described`` with score instead of stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(_matrix(batch)))], [*batch.schema.names[:-1], "score"])

    return described.mapInArrow(run, described.drop("stats").schema.add("score", "double"))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Discriminant:
    """The discriminant of about ``most`` labelled rows outside fold 0; a document with several labels takes the highest.

    The rows are drawn by a hash of the id, so reruns agree, and only their texts are described.
    """
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != 0))
    marks = materialise(marks.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")), "marks")
    share = min(1.0, most / max(1, marks.count()))
    drawn = marks.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    few = F.broadcast(drawn) if most <= SMALL else drawn  # about ``most`` pairs of an id and a label
    rows = docs.select("doc_id", "text").join(few, "doc_id")
    return fit(materialise(describe(rows, "label").select("stats", "label"), "statistics"))


def classify(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep``, score and predicted of every row of ``docs``."""
    scored = score(describe(docs, "doc_id", *keep), train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, with unchanged columns."""
    model = train(docs, labels)
    # a few hundred numbers, as many for any corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                x = np.array([statistics(t or "") for t in some.column("text").to_pylist()])
                yield some.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op4_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(spread(docs.select("doc_id", "text")), labels).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
