"""Tables of patterns and of read requests, and the text budget, against plain loops."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import reading

DOCS = [(1, "/wiki/a.md", "wiki", "ready", False, "# One\ntext\n## Two\nmore\n# One\nagain"), (2, "/wiki/b/c.md", "system", "ready", False, None), (3, "/sources/x[1].txt", "source", "draft", False, "x"), (4, "/wiki/gone.md", "wiki", "ready", True, "y")]
SCHEMA = "doc_id long, path string, kind string, status string, archived boolean, content_md string"


def test_patterns_against_fnmatch(spark):
    r = random.Random(3)
    paths = sorted({"/" + "".join(r.choice("ab/.[*") for _ in range(r.randrange(1, 9))) for _ in range(150)})
    docs = spark.createDataFrame([(i, p, "wiki", "ready", i % 7 == 0, "") for i, p in enumerate(paths)], SCHEMA)
    asked = sorted({"".join(r.choice(["a", "b", "/", ".", "*", "?", "[ab]", "[!a]"]) for _ in range(r.randrange(1, 6))) for _ in range(120)}) + ["*", "/a", ""]
    patterns = spark.createDataFrame([*enumerate(asked), (999, None)], "pattern_id long, pattern string")
    got = {(x["pattern_id"], x["path"]) for x in reading.matches(docs, patterns).collect()}
    want = {(i, p) for i, a in enumerate(asked) for k, p in enumerate(paths) if k % 7 and fnmatch.fnmatchcase(p, a if a.startswith("/") else f"/{a}")}
    assert got == want and len(want) > 500


def test_lists_are_cut_by_path(spark):
    rows = reading.listed(spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame([(1, "*"), (2, "wiki/*"), (3, "none*")], "pattern_id int, pattern string"), 2).orderBy("pattern_id", "position").collect()
    assert [(x["pattern_id"], x["line"]) for x in rows] == [(1, "- `/sources/x[1].txt` [source] (draft)"), (1, "- `/wiki/a.md` [wiki] (ready)"), (2, "- `/wiki/a.md` [wiki] (ready)"), (2, "- `/wiki/b/c.md` [system] (ready)")]


def test_read_requests(spark):
    pages = spark.createDataFrame([(1, 1, "p1"), (1, 2, None), (1, 10, "p10")], "doc_id long, page_no int, text string")
    asked = [(1, "wiki/a.md", "", None), (2, "/wiki/a.md", "2-11,1", ["One"]), (3, "/wiki/a.md", "5", None), (4, "/wiki/a.md", None, [" one ", ""]), (5, "wiki/*", "1", None), (6, "zzz*", None, None), (7, "/wiki/gone.md", None, None), (8, "/wiki/b/c.md", None, None), (9, "/wiki/a.md", "", ["none"]), (10, "/wiki/a.md", "", ["two", "One"])]
    got = {x["request_id"]: x["text"] for x in reading.read(spark.createDataFrame(DOCS, SCHEMA), pages, spark.createDataFrame(asked, "request_id long, path string, pages string, sections array<string>")).collect()}
    assert got == {
        1: DOCS[0][5], 2: "## Page 1\n\np1\n\n## Page 2\n\n\n\n## Page 10\n\np10", 3: "No pages found for `/wiki/a.md` and range `5`.", 4: "# One\ntext\n\n# One\nagain",
        5: "- `/wiki/a.md` [wiki]\n- `/wiki/b/c.md` [system]", 6: "No documents match `zzz*`.", 7: "Document `/wiki/gone.md` not found.", 8: "", 9: "", 10: "# One\ntext\n\n## Two\nmore\n\n# One\nagain",
    }


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15, 100])
def test_budget_at_every_limit(spark, limit):
    docs = {1: ["abc", "", None, "de"], 2: [""], 3: ["abcdefgh" * 2], 4: ["a", "b", "c", "d", "e"]}
    rows = [(d, n, t) for d, texts in docs.items() for n, t in enumerate(texts)]
    got = {x["doc_id"]: x["text"] for x in reading.budgeted(spark.createDataFrame(rows, "doc_id long, nth int, text string"), limit).collect()}
    whole = {d: "\n\n".join(t or "" for t in texts) for d, texts in docs.items()}
    assert got == {d: t if len(t) <= limit else t[:limit] + "\n\n[truncated]" for d, t in whole.items()}


def test_a_pattern_is_tried_on_paths_with_its_pieces_only(spark, monkeypatch):
    """Patterns that begin with a star are as few trials as others."""
    n = 400
    docs = spark.createDataFrame([(i, f"/wiki/src{i % 7}/doc-{i}.md", "wiki", "ready", False, "") for i in range(n)], SCHEMA)
    asked = [(i, ["*-%d?.md", "/wiki/*/doc-%d.md", "*src*/doc-%d.m?", "*oc-%d.*"][i % 4] % i) for i in range(n)]
    got = reading.matches(docs, spark.createDataFrame(asked, "pattern_id long, pattern string"))
    want = {(i, p) for i, a in asked for k in range(n) if fnmatch.fnmatchcase(p := f"/wiki/src{k % 7}/doc-{k}.md", a if a.startswith("/") else f"/{a}")}
    assert {(x["pattern_id"], x["path"]) for x in got.collect()} == want
    tried = []
    monkeypatch.setattr(reading.F, "regexp_like", lambda path, regex: tried.append(1) or F.lit(True))
    assert reading.matches(docs, spark.createDataFrame(asked, "pattern_id long, pattern string")).count() < 3 * n and tried
