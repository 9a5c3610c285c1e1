"""Each operator on odd rows, on empty tables, and against a plain version or held-out rows."""

import json
import zlib

import numpy as np
import pytest

from tesserine.llm import decontaminate, htmltext, jaccard, lattice, mixing, queries, sharding, tokenids
from tests.oracle import same

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (0, "", "en", "a", 0),
    (1, None, None, None, None),
    (2, "one two", "en", "a", 7),
    (3, LONG, "en", "a", len(LONG)),
    (4, "Das ist ein Satz, und er ist lang genug für fünf Wörter.", "de", "b", 60),
    (4, "Das ist ein Satz, und er ist lang genug für fünf Wörter.", "de", "b", 60),
    (None, "no id here but words enough for shingles", "en", None, 40),
    (7, " \n\t ", "en", "b", 4),
    (8, "1234 5678 ... !!!", "en", "c", 17),
    (9, "One TWO", "en", "a", 7),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of every table that are called like those that the operators make.
EXTRA = ", n int, rep long, cls long, stats string, score double, copies long, shard int, comp long, key string, k1 long, gid long, base double, host string, lines string, block long, row long, doc string, sig string, word string, pos int, form string, output string, spans string"


def write(spark, folder, empty):
    pages = [(0, "http://a.example/x/1", "<html><nav>Menu</nav><article><h1>T</h1><p>a &amp; b</p></article></html>"), (1, "http://a.example/x/2", None), (2, None, ""), (2, None, ""), (None, "not a url", "<p>x" * 500)]
    bench = [(0, "one two three four five six seven eight nine ten"), (1, None), (2, ""), (0, "one two three four five six seven eight nine ten")]
    vectors = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0, 0.0], 1), (8, [0.9, 0.1], 1), (0, [1.0, 0.0], 1), (9, [], 1)]
    labels = [(2, 1, 0), (3, 0, 0), (4, 1, 0), (4, 0, 0), (8, 0, 0), (9, 1, 0), (None, None, None)]
    for name, rows, schema in (
        ("documents", DOCS, DOC_SCHEMA),
        ("pages", pages, "page_id long, url string, html string"),
        ("benchmark", bench, "item_id long, text string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        wide = [r + (None,) * EXTRA.count(", ") for r in rows]
        spark.createDataFrame([] if empty else wide, schema + EXTRA).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd") / "t", False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none") / "t", True)


ROWS = {"op1": 5, "op2": 11, "op3": 5, "op9": 0, "op12": 3}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_odd_rows(spark, odd, name):
    got = queries.queries()[name](spark, odd).collect()
    assert len(got) == ROWS.get(name.split("_")[0], len(DOCS))


def test_defined_results_of_odd_rows(spark, odd):
    run = {n.split("_")[0]: lambda n=n: queries.queries()[n](spark, odd).collect() for n in queries.queries()}
    assert sorted((r["page_id"], r["text"]) for r in run["op1"]() if r["page_id"] is not None) == [(0, "T\na & b"), (1, ""), (2, ""), (2, "")]
    by = {}
    for r in run["op2"]():
        by.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    assert by[0] == {(3, 0, True)} and by[1] == {(3, 0, False)} and by[8] == {(3, 0, False)}
    assert all(by[k] == {(0, k, True)} for k in (2, 3, 4, 5, 6, 7, 9))
    assert {(r["page_id"], r["payload_bytes"]) for r in run["op3"]()} >= {(1, 0), (2, 0)}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in run["op4"]())
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in run["op5"]() if r["doc_id"] in (0, 1, 7)}
    assert sizes == {k: (0, 0) for k in (0, 1, 7)}
    assert {r["doc_id"]: r["n_tokens"] for r in run["op6"]() if r["doc_id"] in (0, 1)} == {0: 1, 1: 1}
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in run["op7"]() if r["doc_id"] in (0, 1, 7, 8)} == {k: ("und", 0.0) for k in (0, 1, 7, 8)}
    shards = {r["doc_id"]: r for r in run["op8"]()}
    assert (shards[1]["size"], shards[0]["size"], shards[2]["size"]) == (1, 1, 8) and shards[2]["text_crc32"] == zlib.crc32(b"one two")
    sets = {}
    for r in run["op10"]():
        sets.setdefault(r["doc_id"], (r["n_shingles"], r["component_id"]))
    assert (sets[0], sets[1], sets[7]) == ((0, 0), (0, 1), (0, 7)) and sets[2] == (1, 2) and sets[9] == (1, 2) and sets[4][1] == 4
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in run["op11"]() if r["doc_id"] != 8} == {(0, 0, 0), (1, 0, 0), (2, 2, 0), (3, 100_000, 0), (4, 12, 0), (None, 8, 0), (7, 0, 0), (9, 2, 0)}
    assert {(r["word"], r["n"]) for r in run["op12"]()} == {("lorem", 20_000), ("ipsum", 20_000), ("dolor", 20_000)}
    assert {(r["doc_id"], r["n"], r["form"]) for r in run["op13"]() if r["doc_id"] in (0, 1)} == {(0, 0, "plain"), (1, 0, "plain")}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, odd).collect()} <= {r[0] for r in DOCS}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_html_lines():
    page = "<body><header>Site</header><article><p>A &eacute;\n b<br>c</p><!-- x --><div class='comments'>no</div></article><footer>f</footer></body>"
    assert [t for _, t in htmltext.lines_of(page)] == ["A é b", "c"]


def test_shared_lines_are_a_longest_common_subsequence():
    assert [*sorted(htmltext.shared_lines(list("abcde"), list("xbxdye")))] == [1, 3, 4]


def test_pages_without_article_lose_their_template():
    assert htmltext.difference([1, 1, 1], ["menu", "a long own text of this page", "foot"], [["menu", "other", "foot"]]) == "a long own text of this page"


def test_pages_with_article_are_differenced_too():
    def lines(own):
        return htmltext.lines_of(f"<div>Home News About</div><main><p>{own}</p></main><article>A card</article><div>All rights</div>")

    mine, other = lines("the long main text of this page, beside a card"), lines("what stands on the other page")
    got = htmltext.difference([k for k, _ in mine], [t for _, t in mine], [[t for _, t in other]])
    assert got.split("\n") == ["the long main text of this page, beside a card", "A card"]


def test_short_page_under_a_long_template():
    menu = ["a very long menu of this site", "and its second very long line", "foot"]
    assert htmltext.difference([1] * 4, [*menu, "own"], [[*menu, "other"], [*menu, "third"]]) == "own"
    own = ["a long line of the text of a page and its near copy", "the date"]
    assert htmltext.difference([1] * 3, [*own, "foot"], [[own[0], "other date", "foot"], ["another text", "foot"]]) == "\n".join(own)


def test_neighbours_beyond_copies_and_range_edges(spark):
    """Copies look beyond their run for a neighbour, and the text is the same however the pages are divided."""
    page = lambda own: f"<div>Home</div><div>News and weather</div><p>{own}</p><div>All rights</div>"
    owns = ["first", *["copy"] * 9, "second", "third", *["copy"] * 4, "last"]
    rows = [(i, f"http://a.example/x/{i:03}", page(own)) for i, own in enumerate(owns)] + [(99, "http://b.example/", page("alone"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for ranges in (1, 2, 5, 40):
        got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, ranges).collect()}
        assert got.pop(99).split("\n") == ["Home", "News and weather", "alone", "All rights"]
        assert got == dict(enumerate(owns))


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    y = lattice.nearest_e8(x)
    steps = lattice.e8_steps()
    assert len({tuple(s) for s in steps}) == 240
    d = ((x - y) ** 2).sum(1)
    assert all((((x - (y + s)) ** 2).sum(1) >= d - 1e-9).all() for s in steps)


def planted_vectors(seed):
    """Bases with partners at cosines from 0.93 on, a cluster, exact copies, and partners just below the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = [(v, int(i % 3)) for i, v in enumerate(base)]
    for i, c in zip(range(0, 1500, 2), [0.9301, 0.935, 0.94, 0.96, 0.99, 0.999, 0.92] * 200, strict=False):
        other = rng.normal(size=64)
        other -= other @ base[i] * base[i]
        out.append((c * base[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other), int(i % 3)))
    out += [(base[1] + 0.02 * rng.normal(size=64), 1) for _ in range(60)]
    out += [(base[k], int(k % 3)) for k in (4, 4, 10)] + [(base[5], 0), (base[5], None)]
    return [(int(k), v.tolist(), label) for k, (v, label) in zip(rng.permutation(len(out)), out, strict=True)]


def all_pairs(rows):
    ids, label = np.array([r[0] for r in rows]), np.array([-1 if r[2] is None else r[2] for r in rows])
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    return ids, near


def test_lattice_links_against_all_pairs(spark):
    """Recall of the links, none that is not there, and the components that the links make."""
    rows = planted_vectors(7)
    ids, near = all_pairs(rows)
    assert near.sum() > 4000 and (near.sum(axis=1) == 1).sum() > 800
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _, groups, links = lattice.near_duplicates(vectors)
    first = {r["gid"]: r["first_id"] for r in groups.collect()}
    at = {int(k): i for i, k in enumerate(ids)}
    met = [(at[first[r["a"]]], at[first[r["b"]]]) for r in links.collect()]
    assert len(set(met)) == len(met) and all(near[x, y] for x, y in met)
    alone = [i for i in range(len(ids)) if near[i].sum() == 1]
    found = {x for pair in met for x in pair}
    assert np.mean([i in found for i in alone]) >= 0.98


def test_lattice_query_against_all_pairs(spark, tmp_path):
    rows = planted_vectors(8)
    ids, near = all_pairs(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in queries.queries()["op2_lattice_near_dup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    want = near.sum(axis=1)
    exact = sum(got[int(k)]["n_links"] == n for k, n in zip(ids, want, strict=True))
    assert all(got[int(k)]["n_links"] <= n for k, n in zip(ids, want, strict=True)) and exact >= 0.98 * len(ids)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], label.max()).min(axis=1))
        if (low == label).all():
            break
        label = low
    right = sum(got[int(k)]["component_id"] == c for k, c in zip(ids, label, strict=True))
    assert right >= 0.98 * len(ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_lattice_keys_of_two_lattices():
    """Pairs just above the threshold meet under keys of two lattices as well, and unrelated ones hardly ever."""
    rng = np.random.default_rng(9)
    a, r = rng.normal(size=(2, 1500, 64))
    a = lattice.unit(a)
    r = lattice.unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    for lattices in (1, 2):
        for c, low, high in ((0.931, 0.95, 1), (0.0, 0, 0.02)):
            b, met = c * a + np.sqrt(1 - c * c) * r, np.zeros(1500, bool)
            for t in range(lattice.TABLES[lattices]):
                (ha, na), (hb, nb) = lattice.cells_of(a, t, lattices), lattice.cells_of(b, t, lattices)
                met |= (na == hb[:, None]).any(axis=1) | (nb == ha[:, None]).any(axis=1)
            assert low <= met.mean() <= high


def test_lattice_vectors_of_any_size_and_shared_ids(spark, tmp_path):
    rows = [(0, [1e-200, 0.0], 1), (1, [2e-200, 1e-201], 1), (2, [1e200, 0.0], 1), (5, [0.0, 1.0], 2), (5, [1.0, 0.0], 2), (6, [0.99, 0.05], 2), (None, [0.0, 3.0], 2)]
    rows += [(7, [1.0, 0.0], None), (8, None, 2), (9, [0.0, 0.0], 2), (10, [float("inf"), 1.0], 2), (11, [1.0, None], 2), (12, [], 2), (13, [1.0, 0.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in queries.queries()["op2_lattice_near_dup"](spark, str(tmp_path)).collect()), key=str)
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 1, 5, None)] + [(k, 0, k, True) for k in range(7, 14)]
    assert got == sorted(want, key=str)


def test_lattice_divides_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=64)
    rows = [(i, (base + 0.01 * rng.normal(size=64)).tolist(), 1) for i in range(120)]
    monkeypatch.setattr(lattice, "CELL", 10)
    monkeypatch.setattr(lattice, "PAIRS", 50)
    links = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))[2].collect()
    assert len({(r["a"], r["b"]) for r in links}) == len(links) == 120 * 119 // 2


def test_balanced_sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(mixing.document_sizes(docs)).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        a = by.setdefault(r["source"], [0, r["target"], 0])
        a[0] += r["taken"]
        a[2] = max(a[2], r["size"])
    assert abs(sum(a[1] for a in by.values()) - sum(r["size"] for r in rows)) < 1
    assert all(abs(got - want) <= max(biggest, 0.02 * want) for got, want, biggest in by.values())


def test_large_cells_are_dealt_whole(spark):
    """One size in two sources: the copies meet the targets to a document, though the groups are of unequal size."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id < 28860, 'a', 'b') as source", "10L as size")
    by = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 for r in by.values())


def test_rounding_of_many_sizes(spark):
    """The words of all cells are met to a few, though each of them is rounded; no cell gives more than it has."""
    cells = [("a", s, 1 + s % 3, (s * 7 % 24) / 24) for s in range(1000)] + [(None, 5, 3, 0.5), ("b", 20_000, 7, 0.3), ("b", 3, 2, 0.3), ("c", 0, 9, 0.4)]
    got = mixing.round_cells(spark.createDataFrame(cells, "source string, size long, n long, part double")).collect()
    assert len(got) == len(cells) and all(0 <= r["extra"] <= (r["n"] if r["part"] else 0) for r in got)
    for source, most in (("a", 3), (None, 5), ("b", 10_003), ("c", 0)):
        assert abs(sum((r["n"] * r["part"] - r["extra"]) * r["size"] for r in got if r["source"] == source)) <= most


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """The contract word for word: share, stop at the cap, share the excess again until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > cap * sizes[k]}
        if not over:
            target.update(share)
            break
        for k in over:
            target[k] = float(cap * sizes[k])
            left -= target[k]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 5, "b": 5, "c": 5, "d": 900, None: 85}, {"a": 0, "b": 100}, {None: 7}, {"Z": 1, "a": 2, "é": 3, "b": 4000}])
def test_targets_against_the_plain_loop(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_newton_steps_solve_the_dual(spark):
    """Base rates that differ and rates at the cap: the tilted rates meet each target, after more than one step."""
    moments = [("a", 0.5, 1000), ("a", 1.0, 500), ("a", 2.0, 800), ("b", 1.0, 900), (None, 0.1, 50), (None, 4.0, 50)]
    targets = {"a": 4800.0, "b": 300.0, None: 160.0}
    df = spark.createDataFrame(moments, "source string, base double, words long")
    want = spark.createDataFrame(list(targets.items()), "source string, target double")
    x = {r["source"]: r["x"] for r in mixing.balance(df, want).collect()}
    one = {r["source"]: r["x"] for r in mixing.balance(df, want, most=1).collect()}
    for source, target in targets.items():
        rates = [(w, min(3.0, q * np.exp(x[source]))) for s, q, w in moments if s == source]
        assert sum(w * r for w, r in rates) == pytest.approx(target, rel=1e-8)
        assert abs(one[source] - x[source]) > 1e-3


def test_mix_of_different_base_rates(spark):
    rows = [(i, "ab"[i % 2], 5 + i % 90, [0.2, 1.0, 3.0][i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, base double")).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 90
        mean = [np.mean([r["copies"] for r in mine if r["doc_id"] % 3 == k]) for k in range(3)]
        assert mean[0] < mean[1] < mean[2] <= 3


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = sharding.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n)
        assert sorted(r["x"] for r in df.collect()) == list(range(n))
    df = sharding.permute(spark.range(97).select("id", "id").toDF("i", "x"), "x", 97)
    assert all(r["i"] == r["x"] for r in sharding.permute(df, "x", 97, inverse=True).collect())


def test_shards_are_even_and_gapless(spark):
    got = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in queries.queries()["op6_elias_fano_token_ids"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 1, 7, 1000, 10**9], list(range(0, 5000, 3))])
def test_elias_fano_round_trip(values):
    f = tokenids.EliasFano(tokenids.ef_encode(np.array(values, np.int64)))
    assert f.slice(0, len(values)).tolist() == values and [f.get(i) for i in range(len(values))] == values
    assert all(f.slice(a, b).tolist() == values[a:b] for a in range(0, len(values), 301) for b in range(a, len(values), 433))


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.queries()["op4_quadratic_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in got]) > 0.85


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.queries()["op7_marginal_unigram_langid"](spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.9


def test_edit_distance_to_a_passage():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = np.random.default_rng(2)
    for _ in range(300):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 14)).tolist()
        assert decontaminate.nearest(item, text)[0] == plain(item, text)


def test_decontamination_recall_against_all_windows():
    """Items with random word edits inside other words: what the plain comparison finds, the index finds."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    pick = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    items = [pick(int(n)) for n in rng.integers(10, 60, 60)]
    index = decontaminate.Index([(i, " ".join(ws)) for i, ws in enumerate(items)])
    planted = found = 0
    for k, ws in enumerate(items):
        for share in (0, 0.1, 0.2):
            ws2 = list(ws)
            for _ in range(int(len(ws) * share)):
                at = int(rng.integers(0, len(ws2)))
                match rng.integers(0, 3):
                    case 0:
                        ws2[at] = "other"
                    case 1:
                        del ws2[at]
                    case _:
                        ws2.insert(at, "other")
            text = " ".join([*pick(40), *ws2, *pick(40)])
            planted += 1
            found += k in {m[1] for m in index.matches([text, "nothing here"])}
    assert found >= 0.97 * planted
    assert not list(index.matches([" ".join(pick(20_000))]))


def test_items_cut_at_the_edges_of_documents():
    """A document that begins or ends inside an item, between other documents of a slice."""
    rng = np.random.default_rng(5)
    items = [[f"w{i}" for i in rng.integers(0, 3000, int(n))] for n in rng.integers(10, 60, 60)]
    index = decontaminate.Index([(i, " ".join(ws)) for i, ws in enumerate(items)])
    for k, ws in enumerate(items):
        for n in range(1, len(ws) // 5 + 1):
            for cut in (ws[n:], ws[:-n], ws[n:] + ["other"] * 9, ["other"] * 9 + ws[:-n]):
                alone = [m[1:] for m in index.matches([" ".join(cut)])]
                assert k in {m[0] for m in alone}
                assert [m[1:] for m in index.matches(["x y z u " * 9, " ".join(cut), "x y", ""]) if m[0] == 1] == alone


def test_jaccard_components_against_all_pairs(spark):
    """Chains and stars of copies with edits, against comparing every pair."""
    rng = np.random.default_rng(4)
    pick = lambda n: [f"v{i}" for i in rng.integers(0, 400, n)]
    passage, docs = pick(60), []
    for size in (8, 30, 60, 200):
        base = pick(size)
        docs.append(base)
        for _ in range(25):
            copy = list(docs[-1] if rng.random() < 0.5 else base)
            for _ in range(int(rng.integers(0, max(2, size // 25)))):
                copy[int(rng.integers(0, len(copy)))] = pick(1)[0]
            docs.append(copy)
    docs += [pick(30) + passage for _ in range(20)] + [passage] * 3
    texts = [" ".join(d) for d in docs]
    words = jaccard.Words()
    sets = [set(jaccard.shingles(t, words).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_pipeline_keeps_columns_and_drops_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.schema == docs.schema
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    one, two, other = ("a first text that stands here more than once", "a second text that has no id in the table", "a text that shares its id with the first one")
    rows = [(5, one), (5, one), (3, one), (None, two), (None, two), (5, other), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(3, one), (None, two), (5, other), (None, ""), (None, "")], key=str)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert json.dumps(list(entry.oracle_sql()))
