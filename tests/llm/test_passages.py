"""Substring dedup, spelling variants and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tesserine.llm import fim, queries, spelling, substrings
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("name", ["op11_seed_extend_dedup", "op12_gram_spelling_variants", "op13_bit_parallel_fim"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


# --- substring dedup --------------------------------------------------------

def plain_kept(rows):
    """Every window of every document, by its words."""
    order = lambda d: substrings.LAST if d is None else d
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, order(d)), order(d))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def passages(seed):
    """Copies, near copies, shared passages of 5 to 60 words, repeats inside a document, texts of few words."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c"]) if r.random() < 0.3 else "w%d" % r.randrange(300)
    shared = [[word() for _ in range(r.choice([5, 12, 13, 14, 25, 60]))] for _ in range(12)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(shared) if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 40))]
        if rows and r.random() < 0.25:
            w = (r.choice(rows)[1] or "").split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = "edited"
        rows.append((r.choice([d, d, d, r.randrange(120), None]), r.choice([" ", "\n", "\t "]).join(w) if r.random() < 0.97 else None))
    return rows + [(500, "w1 " * 30_000), (501, "w1 " * 100), (502, "x" * 100_000), (503, ""), (503, "w1 " * 100)]


@pytest.mark.parametrize("seed", range(3))
def test_words_that_stay_are_those_of_the_plain_version(spark, seed):
    rows = passages(seed)
    got = substrings.without_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == plain_kept(rows)


def test_repeats_are_maximal_and_long_enough(spark):
    common = [f"c{i}" for i in range(40)]
    rows = [(1, " ".join(common)), (2, " ".join(["x", *common[:20], "y", *common[27:], "z", *common[5:16]]))]
    got = {r["doc_id"]: r["repeats"] for r in substrings.without_repeats(frame(spark, rows)).collect()}
    assert [tuple(s) for s in got[2]] == [(1, 21), (22, 35)] and got[1] == []


def test_words_are_hashed_as_they_are_divided():
    """Across texts of one batch, pieces of every size, empty and null texts, words next to the edges."""
    texts = ["a b  a", None, "", "b", "ab a", " é\x0bé\x85 x", "y" * 5000, "\n", "b a"]
    want = [w for t in texts for w in (t or "").encode().split()]
    where = [i for i, t in enumerate(texts) for _ in (t or "").encode().split()]
    for piece, cut in ((1, 0), (7, 0), (1 << 20, 0), (3, 1)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substrings, "PIECE", piece)
            skip = len((texts[0] or "").split()) if cut else 0
            h, doc = substrings.hashed(pa.array(texts).slice(cut), substrings.Powers())
        assert doc.tolist() == [i - cut for i in where[skip:]]
        told = dict(zip(want[skip:], h.tolist(), strict=True))
        assert len(set(told.values())) == len(told) and [told[w] for w in want[skip:]] == h.tolist()


def test_every_equal_window_has_an_equal_anchor():
    import numpy as np

    w = np.random.default_rng(1).integers(1, 2**63, 400, dtype=np.uint64)
    other = np.concatenate([w[50:63], w[:50]])
    seeds, chosen = substrings.anchors(w)
    there, where = substrings.anchors(other)
    assert seeds[chosen[50]] == there[where[0]] and chosen[50] - 50 == where[0]


# --- spelling variants ------------------------------------------------------

def plain_variants(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def spelled(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abÀé") for _ in range(r.randrange(4, 9))) for _ in range(150)] + ["Straße", "naïve", "÷×÷×÷×"]
    return [(r.choice([d, None, 3]), r.choice([", ", " ", "-"]).join(r.choice(words[: r.randrange(2, len(words))]) for _ in range(60))) for d in range(60)] + [(1, None), (2, ""), (5, "lettersletters" * 3000), (5, "lettersletters" * 3000), (5, "lettersletters" * 3000)]


@pytest.mark.parametrize("block", [20_000, 7])
def test_variants_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelled(block)
    got = sorted(map(tuple, spelling.variants(frame(spark, rows)).collect()), key=repr)
    assert got == plain_variants(rows) and any(x[1] for x in got)


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    steps = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    text = " ".join(w for i, w in enumerate(steps) for _ in range(3 * 2**i))
    got = {r["word"]: r["root"] for r in spelling.variants(frame(spark, [(900, text)])).collect()}
    assert got == {r[0]: r[2] for r in plain_variants([(900, text)])}


# --- fill in the middle -----------------------------------------------------

TEXTS = ["", " ", "a", " a", "a ", "one two  three\n", "\t\x0b\x0c\r x y\u0085z ", "ein <S> Satz", "é ñ 漢字 𝄞 word", "<P", "S> <", "word " * 5000, "x" * 60_000, " " * 3000]


def plain_fim(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n, text = len(units), text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_units_and_places_are_those_of_the_pattern():
    for t in TEXTS:
        starts = fim.unit_starts(t)
        want = [m.start() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
        assert starts.bit_count() == len(want)
        assert [fim.select(starts, k) for k in range(0, len(want), 1 + len(want) // 50)] == want[:: 1 + len(want) // 50]


def test_texts_are_turned_and_restored(spark):
    rows = [(d, t) for d, t in enumerate(TEXTS * 8)] + [(None, "no id"), (3, None), (3, "same"), (3, "same")]
    done = fim.fill_in_middle(frame(spark, rows))
    got = done.withColumn("back", fim.restored(done["output"], done["form"])).collect()
    want = sorted(((d, *plain_fim(d, t), t or "") for d, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
