"""The inverted index against a plain reading of every text."""

import random
import re

import pytest

from tesserine.operators import fulltext


def plain(texts, query, limit):
    hits = []
    for key, t in texts:
        if key is None or t is None:
            continue
        tk = re.findall(r"\w+", t.lower())

        def count(item):
            words, prefix = item
            if prefix:
                return sum(x.startswith(words[0]) for x in tk)
            return sum(tuple(tk[i : i + len(words)]) == words for i in range(len(tk) - len(words) + 1))

        parsed = fulltext.parse(query)
        if any(all(count(i) for i in must) and not any(count(i) for i in never) for must, never in parsed):
            hits.append((-float(sum(count(i) for i in {i for m, _ in parsed for i in m})), key))
    return [(n + 1, key, -score) for n, (score, key) in enumerate(sorted(hits)[:limit])]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("one  Two", [([(("one",), False), (("two",), False)], [])]),
        ('"one two" -three OR fo*', [([(("one", "two"), False)], [(("three",), False)]), ([(("fo",), True)], [])]),
        ("a-b", [([(("a", "b"), False)], [])]),
        ("-only", []),
        (' "" OR - * ', []),
    ],
)
def test_queries_are_parsed(query, want):
    assert fulltext.parse(query) == want


QUERIES = ["w1 w2", "w1", "w3 w3 w4", '"w1 w2"', '"w2 w1 w2"', "w1 OR w19", "w1 -w2", "w1*", "w1* -w1", '-"w1 w2" w1 OR "w0 w0"', "nowhere", "", "-w1", "ß0 é", "w5 w6 w7 OR w8 w9", '"w1 w1"', "w0-w1", "w1 OR -w2"]


@pytest.mark.parametrize("first", [1, 8])
def test_hits_are_those_of_a_scan(spark, first, tmp_path):
    r = random.Random(first)
    word = lambda: r.choice([f"w{min(int(r.expovariate(0.25)), 20)}", f"W{r.randrange(20)}", "ß0", "é,"])
    texts = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in r.sample(range(3000), 600)] + [(3001, None), (None, "w1 w2"), (3002, ""), (3003, "w1 " * 5000)]
    df = spark.createDataFrame(texts, "block_id long, text string").repartition(3)
    index = fulltext.write(fulltext.build(df, "block_id", "text", width=16), str(tmp_path / "index"))
    hits, read = fulltext.search(index, QUERIES, 5, first)
    got = {}
    for h in hits.collect():
        got.setdefault(h["query"], []).append((h["rank"], h["id"], h["score"]))
    for q in QUERIES:
        assert sorted(got.get(q, [])) == plain(texts, q, 5), q
    stats = {x["query"]: (x["ranges"], x["read"]) for x in read.collect()}
    assert stats["nowhere"] == (0, 0) and stats["w1"][1] <= stats["w1"][0]
    assert first == 1 or stats["w1"][1] < stats["w1"][0]


def test_hits_within_some_rows(spark):
    texts = [(i, "a " * (i + 1)) for i in range(50)]
    index = fulltext.build(spark.createDataFrame(texts, "id long, text string"), "id", "text", width=4)
    hits, _ = fulltext.search(index, ["a"], 3, 1, within=spark.createDataFrame([(i,) for i in range(0, 40, 7)], "id long"))
    assert [(x["id"], x["score"]) for x in hits.orderBy("rank").collect()] == [(35, 36.0), (28, 29.0), (21, 22.0)]


def test_an_empty_table_and_no_queries(spark):
    index = fulltext.build(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert fulltext.search(index, ["a"], 3)[0].count() == 0 and fulltext.search(index, [], 3)[1].count() == 0


def test_terms_reach_the_scan(spark, tmp_path):
    index = fulltext.write(fulltext.build(spark.createDataFrame([(1, "a b c")], "id long, text string"), "id", "text"), str(tmp_path / "index"))
    words, asked, terms, prefixes = fulltext._queries(spark, ["a"])
    plan = fulltext.bounds(index, words, asked, terms, prefixes)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(term,a)" in plan and "places" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_an_index_shuffles_texts_once_and_no_words(spark):
    """Ranges over many batches, an id twice, negative ids, a text without words."""
    texts = [(i % 50 - 20, f"w{i % 3} W{i % 7} x " * (i % 9)) for i in range(60)] + [(7, None), (8, "--")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        index = fulltext.build(df, "id", "text", width=16)
        got = {(b["term"], b["range"]): (b["top"], list(zip(b["ids"], b["counts"], b["places"], strict=True))) for b in index.collect()}
        assert index.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, t in texts:
        for place, w in enumerate(re.findall(r"\w+", (t or "").lower())):
            want.setdefault((w, key // 16), {}).setdefault(key, []).append(place)
    assert got == {k: (max(map(len, b.values())), [(i, len(b[i]), sorted(b[i])) for i in sorted(b)]) for k, b in want.items()}
    plan = fulltext.build(df.select("*"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
