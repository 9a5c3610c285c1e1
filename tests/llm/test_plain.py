"""The quality scores and each stage of the pipeline against plain versions, every stage on what the one before it has kept."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tesserine.llm import decontaminate, quality
from tests.llm.test_operators import SF, plain_targets


def plain_scores(docs, labels):
    """docs: (doc_id, text); labels: (doc_id, quality).  The discriminant by means, covariances and solved systems, without Cholesky factors."""
    mark = {}
    for d, q in labels:
        if q in (0, 1) and d is not None and zlib.crc32(str(d).encode()) % 5:
            mark[d] = max(q, mark.get(d, 0))
    x = np.array([quality.statistics(t or "") for _, t in docs])
    y = np.array([mark.get(d, -1) for d, _ in docs])
    fit = x[y >= 0]
    z = np.clip((x - fit.mean(0)) / np.maximum(fit.std(0), 1e-6), -6, 6)
    parts = []
    for k in (0, 1):
        own = z[y == k]
        mean, cov = own.mean(0), np.cov(own.T, bias=True)
        cov = 0.95 * cov + (0.05 * np.trace(cov) / len(mean) + 1e-6) * np.eye(len(mean))
        far = ((z - mean) * np.linalg.solve(cov, (z - mean).T).T).sum(1)
        parts.append(np.log((y == k).sum() / (y >= 0).sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    return 1 / (1 + np.exp(-np.clip(parts[1] - parts[0], -500, 500)))


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out of the last, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.materialise(stage(spark, held[-1], SF), name))
    return [d.collect() for d in held]


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_scores(spark):
    docs = table(spark, "documents", "doc_id", "text")
    want = dict(zip([d for d, _ in docs], plain_scores(docs, table(spark, "labels", "doc_id", "quality")), strict=True))
    got = quality.op4_quadratic_quality(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_stage(spark, stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[0]]
    scores = plain_scores(docs, table(spark, "labels", "doc_id", "quality"))
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(d for (d, _), s in zip(docs, scores, strict=True) if s >= 0.3)


def test_near_duplicate_stage(stages):
    def shingles(text):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[1]}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x & y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(d for d in sets if find(d) == d)


def test_decontamination_stage(spark, stages):
    """Every item against every passage of every document by the exact edit distance."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [w for _, t in table(spark, "benchmark", "item_id", "text") if (w := split(t))]
    clean = []
    for r in stages[2]:
        words = split(r["text"])
        have = Counter(words)
        hit = False
        for item in items:
            spare = len(item) // 5 if len(item) >= 10 else 0
            if len(item) < decontaminate.MIN_WORDS:
                hit = hit or item == words
            elif sum((Counter(item) & have).values()) >= len(item) - spare:
                hit = hit or decontaminate.nearest(item, words)[0] <= spare
        if not hit:
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(clean) and len(clean) < len(stages[2])


def test_mixing_stage(stages):
    """Whole rows are taken, each source near its target, none more than three times."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    target, taken = plain_targets(dict(sizes)), Counter()
    for r in stages[4]:
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 1) for s in sizes)
    copies = Counter(r["doc_id"] for r in stages[4])
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in stages[3]}
    assert {tuple(r) for r in stages[4]} <= {tuple(r) for r in stages[3]}


def test_sharding_stage(stages):
    slots = {}
    for r in stages[5]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    assert all(r["size"] == len((t or "").encode()) + (t is not None) + (t is None) for r in stages[5] for t in [next(x["text"] for x in stages[4] if x["doc_id"] == r["doc_id"])])
