"""The write side: emptied documents, and page actions folded piece by piece."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tesserine.operators import writing
from tesserine.operators.scans import following, running

DOCS = "doc_id long, workspace_id string, path string, title string, kind string, policy string, archived boolean, content_md string"
ACTIONS = "seq long, path string, title string, op string, content string, reason string"


def test_an_emptied_document_loses_its_blocks_and_pages(spark):
    old = spark.createDataFrame([(1, 0, "a", "h"), (2, 0, "b", "h")], "doc_id long, chunk_idx int, text string, content_hash string")
    ingested = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert [r["doc_id"] for r in writing.apply_blocks(old, old.limit(0), ingested).collect()] == [2]
    pages = old.select("doc_id", F.col("chunk_idx").alias("page_no"), "text")
    assert [r["doc_id"] for r in writing.replace_pages(pages, pages.limit(0), ingested).collect()] == [2]


def test_running_counts_do_not_depend_on_the_parts(spark):
    r = random.Random(4)
    rows = [(k, i, r.random() < 0.3) for i in range(300) for k in (["hot"] if r.random() < 0.9 else ["x", None])]
    df = spark.createDataFrame(rows, "k string, i long, f boolean")
    seen, want = {}, set()
    for k, i, f in rows:
        seen[k] = seen.get(k, 0) + f
        want.add((k, i, seen[k]))
    for width in (1, 7, 1000):
        assert {(x["k"], x["i"], x["n"]) for x in running(df, ["k"], "i", {"n": F.col("f")}, width).collect()} == want


def test_what_follows_does_not_depend_on_the_parts(spark):
    rows = [(k, i) for i in range(0, 200, 3) for k in ("a", None) if i % 7 or k]
    df = spark.createDataFrame(rows, "k string, i long")
    want = {(k, i, min((j for q, j in rows if q == k and j > i), default=None)) for k, i in rows}
    for width in (1, 10, 1000):
        assert {(x["k"], x["i"], x["n"]) for x in following(df, ["k"], "i", "n", width).collect()} == want


def fold(text, actions, created):
    """One text after the other, as a page is written."""
    out = []
    for i, (op, content) in enumerate(actions):
        content = content or ""
        if op != "append_content" or (created and i == 0):
            text = content
        elif content.strip():
            text = content.strip() if not text.strip() else f"{text.rstrip()}\n\n{content.strip()}"
        out.append(text)
    return out


@pytest.mark.parametrize("width", [3, 20_000])
def test_revisions_and_heads_are_those_of_a_fold(spark, width):
    r = random.Random(width)
    docs = [(i, "w", f"/wiki/{i}.md", "T", "wiki", "locked", i == 5, r.choice([None, "", " \n", "old text \n\n", "x"])) for i in range(6)]
    todo = {}
    for seq in range(200):
        path = r.choice(["/wiki/0.md", "/wiki/1.md", "/wiki/2.md", "/wiki/5.md", "/wiki/new.md"])
        todo.setdefault(path, []).append((seq, r.choice(["append_content", "append_content", "append_content", "replace_section"]), r.choice([None, "", " \n ", " a ", "b\n", f"text {seq}"])))
    actions = [(seq, path, f"t{seq}", op, content, "why") for path, rows in todo.items() for seq, op, content in rows]
    d, a = spark.createDataFrame(docs, DOCS), spark.createDataFrame(actions, ACTIONS)
    heads, revisions, pieces = writing.apply_actions(d, a, width)
    live = {x[2]: x[7] for x in docs if not x[6]}
    want = {path: fold(live.get(path) or "", [x[1:] for x in rows], path not in live) for path, rows in todo.items()}
    got = {(x["path"], x["seq"]): x["content_md"] for x in writing.revision_texts(revisions, pieces).collect()}
    assert got == {(path, x[0]): t for path, rows in todo.items() for x, t in zip(rows, want[path], strict=True)}
    found = {x["path"]: x["content_md"] for x in heads.filter("not archived").collect()}
    assert found == {**live, **{path: texts[-1] for path, texts in want.items()}}
    assert {x["path"] for x in revisions.filter("created").collect()} == {"/wiki/5.md", "/wiki/new.md"}


def test_a_hundred_thousand_appends_to_one_page(spark):
    docs = spark.createDataFrame([(1, "w", "/wiki/log.md", "Log", "system", "append_only", False, "# Log")], DOCS)
    took = {}
    for n in (25_000, 100_000):
        actions = spark.range(n).select(F.col("id").alias("seq"), F.lit("/wiki/log.md").alias("path"), F.lit("Log").alias("title"), F.lit("append_content").alias("op"), F.format_string("entry %d " + "x" * 200, "id").alias("content"), F.lit("r").alias("reason"))
        began = time.time()
        heads, revisions, pieces = writing.apply_actions(docs, actions)
        assert revisions.count() == n and pieces.count() == n + 1
        text = heads.first()["content_md"]
        took[n] = time.time() - began
        assert text.count("\n\n") == n and text.startswith("# Log\n\nentry 0 x") and f"\n\nentry {n - 1} x" in text
    assert took[100_000] < 4 * 4 * took[25_000]  # the square would be sixteen times


def test_overview_has_counts_and_updates(spark):
    docs = spark.createDataFrame([(1, "w", "/a", "A & B", "source", "p", False, ""), (2, "w", "/b", "B", "wiki", "p", False, ""), (3, "w", "/c", "C", "wiki", "p", True, "")], DOCS)
    updates = spark.createDataFrame([("w", "A & B", 4, 2), ("v", "x", 0, 0)], "workspace_id string, title string, nodes int, pages int")
    got = {r["workspace_id"]: r for r in writing.overview(docs, updates).collect()}
    assert got["w"]["content_md"].splitlines()[4:9] == ["| Signal | Value |", "| --- | --- |", "| Sources | 1 |", "| Wiki Pages | 1 |", "| Latest Source | A & B |"]
    assert '    source-a-b["A &amp; B"] --> compiler["Compiler"]' in got["w"]["content_md"] and got["w"]["content_md"].endswith("- Created or updated 2 wiki documents.\n") and got["v"]["sources"] == 0
