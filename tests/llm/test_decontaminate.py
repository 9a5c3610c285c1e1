"""Operator 9: the query against an exhaustive scan, short items, blocks, columns that clash."""

import numpy as np

from tesserine.llm import decontaminate


def exhaustive(docs, items):
    """Every item against every document, by the exact distance to the nearest passage of the whole text."""
    out = set()
    for doc_id, text in docs:
        words = decontaminate.words_of(text)
        for item_id, item in items:
            ws = decontaminate.words_of(item)
            if not ws:
                continue
            if len(ws) < decontaminate.MIN_WORDS:
                if ws == words:
                    out.add((doc_id, item_id, 0))
                continue
            number = {w: k for k, w in enumerate({*ws, *words})}
            edits, _ = decontaminate.nearest([number[w] for w in ws], [number[w] for w in words])
            if edits <= decontaminate.edits_allowed(len(ws)):
                out.add((doc_id, item_id, edits))
    return out


def planted(seed):
    rng = np.random.default_rng(seed)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    items = [(i, pick(int(n))) for i, n in enumerate(rng.integers(5, 45, 40))]
    items += [(40, ["no"]), (41, ["all", "of", "this"]), (42, ["a"] * 6), (43, []), (44, items[0][1])]
    docs = [pick(int(n)) for n in rng.integers(0, 120, 60)]
    for _, ws in items[:40]:
        for share in (0.0, 0.1, 0.19, 0.3):
            edited = list(ws)
            for _ in range(int(len(ws) * share)):
                at = int(rng.integers(0, len(edited)))
                edited[at : at + 1] = [[], ["x"], [edited[at], "y"]][int(rng.integers(0, 3))]
            docs.append([*pick(int(rng.integers(0, 30))), *edited, *pick(int(rng.integers(0, 30)))])
    docs += [["No"], ["all", "of", "this"], ["all", "of", "this", "and"], ["b", *["a"] * 6], ["a"] * 5]
    return [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, ", ".join(ws)) for i, ws in items]


def test_matches_against_an_exhaustive_scan(spark):
    docs, items = planted(3)
    want = exhaustive(docs, items)
    assert len(want) > 120 and any(w[2] > 2 for w in want) and {(220, 40, 0), (221, 41, 0), (223, 42, 0)} <= want
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, doc_id int, block string")
    for block_words in (200, 10**6):
        got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_matches(d, b, block_words).collect()}
        assert len({(x, y) for x, y, _ in got}) >= 0.98 * len(want)
        found = {(w[0], w[1]) for w in want}
        assert {(x, y) for x, y, _ in got} <= found
        clean = {r["doc_id"] for r in decontaminate.keep_clean(d, b, block_words).collect()}
        assert clean == {i for i, _ in docs} - {x for x, _, _ in got}


def test_every_item_has_a_key():
    """Items of one word repeated, and items of the least number of words."""
    items = [(0, "la " * 5), (1, "la " * 30), (2, "a b c d e"), (3, "a a a b b")]
    index = decontaminate.Index(items)
    had = np.bincount(np.concatenate([w[3] for w in index.walks]), minlength=4)
    assert (had > 0).all()
    assert {m[1] for m in index.matches(["x " + t for _, t in items])} == {0, 1, 2, 3}


def test_repetitions_that_give_no_keys(monkeypatch):
    """Where the drawn walks find nothing, the walk that always moves on finds every exact passage."""
    monkeypatch.setattr(decontaminate, "REPETITIONS", ())
    monkeypatch.setattr(decontaminate, "MOST", 0)
    index = decontaminate.Index([(0, "one two three four five")])
    assert [m[:3] for m in index.matches(["zero one two three four five six"])] == [(0, 0, 0)]


def test_very_long_texts_and_items(spark):
    rng = np.random.default_rng(1)
    item = " ".join(f"w{i}" for i in rng.integers(0, 5000, 3000))
    text = " ".join(f"w{i}" for i in rng.integers(0, 5000, 100_000))
    d = spark.createDataFrame([(1, text), (2, text + " " + item), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (8, None)], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.find_matches(d, b).collect()] == [(2, 9, 0)]
