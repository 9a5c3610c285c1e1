"""Cleaning of extractions, and the extractor against a plain version."""

import re

import pytest

from tesserine.operators import extracting as E
from tesserine.operators.compiling import split_blocks

TEXTS = [(1, "Alpha Works with Beta. Gamma knows Alpha Works! beta is small. Beta and Gamma met Delta\nAlpha Works again"), (2, "Beta alone. Gamma"), (3, ""), (4, "Solo"), (5, "no capitals here")]


def plain(texts, least, most):
    phrase = re.compile(r"[A-Z]\w+(?: [A-Z]\w+){0,3}")
    edges = {}
    for _, t in texts:
        p = phrase.findall(t)
        for k in (1, 2):
            for a, b in zip(p, p[k:]):
                if a != b:
                    for x, y in ((a, b), (b, a)):
                        edges.setdefault(x, {}).setdefault(y, 0)
                        edges[x][y] += 1
    rank = {a: 1.0 for a in edges}
    for _ in range(E.STEPS):
        got = dict.fromkeys(rank, 0.0)
        for a, out in edges.items():
            for b, n in out.items():
                got[b] += round(n / sum(out.values()) * rank[a], 12)
        rank = {b: round(1 - E.DAMPING + E.DAMPING * g, 9) for b, g in got.items()}
    entities, claims, relations = set(), set(), set()
    for d, t in texts:
        sentences = [phrase.findall(s) for s in re.split(r"(?<=[.!?])\s+|\n+", t)]
        whole = re.split(r"(?<=[.!?])\s+|\n+", t)
        found = {}
        for s, ps in zip(whole, sentences, strict=True):
            for p in ps:
                found.setdefault(p, s)
        best = sorted(found, key=lambda p: (-rank.get(p, 1 - E.DAMPING), p))[:most]
        for p in best:
            r = rank.get(p, 1 - E.DAMPING)
            entities.add((d, p.lower().replace(" ", "-"), p, "concept", f"{p} extracted from T{d}."))
            if round(r / (1 + r), 6) >= least:
                claims.add((d, p, found[p], round(r / (1 + r), 6)))
        for ps in sentences:
            ps = [p for p in dict.fromkeys(ps) if p in best]
            relations |= {(d, a, b, "related_to") for a, b in zip(ps, ps[1:])}
    return entities, claims, relations


@pytest.mark.parametrize(("least", "most"), [(0.0, 20), (0.5, 2)])
def test_extractor_against_a_plain_version(spark, least, most):
    blocks = spark.createDataFrame([(d, 0, t) for d, t in TEXTS], "doc_id long, chunk_idx int, text string").repartition(3)
    titles = spark.createDataFrame([(d, f"T{d}") for d, _ in TEXTS], "doc_id long, title string")
    e, c, r = E.extract_clean(blocks, titles, least, most)
    want = plain(TEXTS, least, most)
    assert {tuple(x) for x in e.select("doc_id", "slug", "title", "entity_type", "summary").collect()} == want[0]
    got = {tuple(x) for x in c.select("doc_id", "entity_title", "text", "confidence").collect()}
    near = lambda rows: sorted((d, p, s, round(x, 4)) for d, p, s, x in rows)
    assert near(got) == near(want[1])
    assert {tuple(x) for x in r.select("doc_id", "source_title", "target_title", "relation_type").collect()} == want[2]


def test_cleaning_by_hand(spark):
    raw = spark.createDataFrame([(1, "S", 0, " A b ", None, None), (1, "S", 1, "a-B", "person", "second"), (1, "S", 2, "  ", "x", "y"), (1, "S", 3, None, "x", "y"), (2, None, 0, "日本", "person", "kept")], "doc_id long, source_title string, nth int, title string, entity_type string, summary string")
    assert sorted(map(tuple, E.clean_entities(raw).drop("nth").collect())) == [(1, "a-b", "A b", "concept", "A b extracted from S."), (2, "item", "日本", "person", "kept")]
    claims = spark.createDataFrame([(1, 0, "A", "t", 1.5, "q" * 500), (1, 1, None, None, None, None), (1, 2, "A", "t", 0.1, ""), (1, 3, "A", "t", -2.0, "")], "doc_id long, nth int, entity_title string, text string, confidence double, quote string")
    assert sorted((x["nth"], x["confidence"], len(x["quote"])) for x in E.clean_claims(claims, 0.5).collect()) == [(0, 1.0, 400), (1, 0.7, 0)]
    rel = spark.createDataFrame([(1, 0, "a", "b", None), (1, 1, "a", "b", "related_to"), (1, 2, "", "b", "x"), (1, 3, "a", None, "x"), (1, 4, "b", "a", None)], "doc_id long, nth int, source_title string, target_title string, relation_type string")
    assert sorted((x["source_title"], x["nth"]) for x in E.clean_relations(rel).collect()) == [("a", 0), ("b", 4)]


def test_extractor_on_split_blocks_is_the_same_twice(spark):
    docs = spark.createDataFrame([(d, f"# Head {d}\n\n{t}") for d, t in TEXTS], "doc_id long, content_md string")
    titles = docs.selectExpr("doc_id", "'T' as title")
    one, two = (sorted(map(tuple, E.extract_clean(split_blocks(docs), titles, 0.0)[1].collect())) for _ in range(2))
    assert one == two and one


def test_lists_are_cleaned_like_rows_and_not_shuffled(spark):
    rows = [(d, "S" if d else None, n, t, k, s) for d, n, t, k, s in [(1, 0, " A b ", None, None), (1, 1, "a-B", "person", "second"), (1, 2, "  ", "x", "y"), (1, 3, None, "x", "y"), (2, 4, "日本", "person", "kept"), (2, 1, "!", None, None), (None, 0, "Q", None, None), (None, 1, "q", "x", None), (3, 0, "z", None, None)]]
    entry = "struct<nth:int,title:string,entity_type:string,summary:string>"
    schema = f"doc_id long, source_title string, raw array<{entry}>"
    flat = spark.createDataFrame(rows, "doc_id long, source_title string, nth int, title string, entity_type string, summary string")
    want = sorted(map(tuple, E.clean_entities(flat).collect()), key=repr)
    once = [(d, s, [r[2:] for r in rows if r[0] == d]) for d, s in [(1, "S"), (2, "S"), (None, None), (3, "S")]] + [(4, "S", None), (5, "S", [])]
    got = E.clean_entity_lists(spark.createDataFrame(once, schema))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # the same documents in a list for each row
    several = [(r[0], r[1], [r[2:]]) for r in reversed(rows)]
    assert sorted(map(tuple, E.clean_entity_lists(spark.createDataFrame(several, schema)).collect()), key=repr) == want


def records(spark, since=()):
    """Records written to shuffles by stage, of stages that are not in ``since``."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    status = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jsc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none))
    return {s.stageId(): s.shuffleWriteRecords() for s in status if s.stageId() not in since}


def test_links_are_shuffled_once_and_not_in_every_step(spark):
    nodes, steps = 60, 8
    rows = [(f"P{a}", f"P{b}", 1 + (a * b) % 5) for a in range(nodes) for b in range(nodes) if a != b]
    edges = spark.createDataFrame(rows, "a string, b string, n long").repartition(3).localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, held = records(spark), len(spark.sparkContext._jsc.getPersistentRDDs())
        got = dict(map(tuple, E.ranks(edges, steps).collect()))
        moved = sum(records(spark, before).values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    parts = spark.sparkContext.defaultParallelism
    assert moved < len(rows) + (steps + 1) * nodes * (parts + 2)
    total, rank = {}, {f"P{a}": 1.0 for a in range(nodes)}
    for a, _, n in rows:
        total[a] = total.get(a, 0) + n
    for _ in range(steps):
        sums = dict.fromkeys(rank, 0.0)
        for a, b, n in rows:
            sums[b] += round(n / total[a] * rank[a], 12)
        rank = {b: round(1 - E.DAMPING + E.DAMPING * g, 9) for b, g in sums.items()}
    assert got == pytest.approx(rank, abs=1e-8)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_claims_take_their_sentence_from_its_block(spark):
    blocks = [(1, 0, "none. Alpha is here. more"), (1, 1, "Beta is first. Alpha again"), (1, 2, None), (None, None, "Gamma has no id. Alpha too"), (2, 0, "Solo one"), (2, 0, "no. Duo Two of the same place"), (3, 0, "")]
    found = spark.createDataFrame(blocks, "doc_id long, chunk_idx int, text string").repartition(3)
    titles = spark.createDataFrame([(d, "T") for d in (1, 2, 3)], "doc_id long, title string")
    claims = E.extract(found, titles)[1]
    got = sorted(map(tuple, claims.select("doc_id", "entity_title", "text").collect()), key=repr)
    assert got == sorted([(1, "Alpha", "Alpha is here."), (1, "Beta", "Beta is first."), (None, "Gamma", "Gamma has no id."), (None, "Alpha", "Alpha too"), (2, "Solo", "Solo one"), (2, "Duo Two", "Duo Two of the same place")], key=repr)
