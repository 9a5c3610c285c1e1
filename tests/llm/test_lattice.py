"""The whole search with one, two and three lattices to a key, on planted pairs just above the threshold."""

import numpy as np
import pytest

from tesserine.llm import lattice


def planted(pairs=800, size=64):
    """Vectors in pairs at cosines of 0.9301 to 0.96, most of them near the threshold, and pairs just below it."""
    r = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, side = unit(r.normal(size=(pairs, size))), r.normal(size=(pairs, size))
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    cos = np.where(np.arange(pairs) % 4 == 3, 0.9297, 0.9301 + 0.03 * r.random(pairs) ** 2)
    b = cos[:, None] * a + np.sqrt(1 - cos**2)[:, None] * side
    rows = [(2 * i + k, v.tolist(), 1) for i, pair in enumerate(zip(a, b, strict=True)) for k, v in enumerate(pair)]
    return rows, {(2 * i, 2 * i + 1) for i in range(pairs) if i % 4 != 3}


@pytest.mark.parametrize("lattices", [1, 2, 3])
def test_recall_with_every_number_of_lattices(spark, lattices):
    rows, want = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    _, groups, links = lattice.near_duplicates(df, lattices=lattices)
    first = {g["gid"]: g["first_id"] for g in groups.collect()}
    found = {tuple(sorted((first[x["a"]], first[x["b"]]))) for x in links.collect()}
    recall = len(found & want) / len(want)
    print(f"lattices {lattices}: recall {recall:.4f}, others {len(found - want)}")
    assert recall >= 0.95 and not found - want
