"""Commands on documents in order, and commits that are visible whole or not at all."""

import threading

import pytest
from pyspark.sql import functions as F

from tesserine.operators import journal
from tesserine.plans import catalogue

DOCS = "doc_id long, path string, title string, kind string, policy string, archived boolean, content_md string"
COMMANDS = "seq long, path string, surface string, operation string, title string, kind string, policy string, old_text string, new_text string"


def command(seq, path, operation, new=None, old=None, surface="agent", title=None, kind=None, policy=None):
    return seq, path, surface, operation, title, kind, policy, old, new


@pytest.fixture(scope="module")
def done(spark):
    docs = [(1, "/wiki/a.md", "A", "wiki", "agent_editable", False, "one two"), (2, "/wiki/b.md", "B", "wiki", "locked", False, "b"), (3, "/wiki/log.md", "L", "system", "append_only", False, None), (4, "/wiki/old.md", "O", "wiki", "locked", True, "gone")]
    commands = [
        command(10, "wiki/a.md", "append", "three"), command(11, "/wiki/a.md", "replace", "2", "two"), command(12, "/wiki/a.md", "replace", "x", "two"), command(13, "/wiki/a.md", "replace", "x", ""),
        command(14, "/wiki/b.md", "append", "no"), command(15, "/wiki/b.md", "archive", surface="api"), command(16, "/wiki/b.md", "append", "late"), command(17, "/wiki/b.md", "create", "new b", title="B2"), command(18, "/wiki/b.md", "append", "more"),
        command(19, "/wiki/log.md", "delete"), command(20, "/wiki/log.md", "append", " entry "), command(21, "/wiki/old.md", "append", "x"), command(22, "wiki/new.md", "create", "text", title="N", policy="append_only"), command(23, "/wiki/new.md", "create", "again"),
        command(24, "/wiki/bad", "create", "x"), command(25, " ", "create", "x"), command(26, "/wiki/none.md", "archive"), command(27, None, "append", "x"), command(28, "/src/", "create", "x", kind="source"),
    ]
    out = journal.run_commands(spark.createDataFrame(docs, DOCS), spark.createDataFrame(commands, COMMANDS).repartition(3), "2024-01-01")
    return {k: v.collect() for k, v in out.items()}


def test_commands_run_in_order_on_what_the_last_one_left(done):
    errors = {r["seq"]: r["error"] for r in done["steps"]}
    assert errors == {10: None, 11: None, 12: "not exactly one match", 13: "not exactly one match", 14: "policy", 15: None, 16: "not found", 17: None, 18: None, 19: "structural page", 20: None, 21: "not found", 22: None, 23: "exists", 24: "not markdown", 25: "empty path", 26: "not found", 27: "not found", 28: "path ends with a slash"}
    texts = {r["revision_id"]: r["content_md"] for r in done["revisions"]}
    assert texts == {10: "one two\n\nthree", 11: "one 2\n\nthree", 15: "b", 17: "new b", 18: "new b\n\nmore", 20: "entry", 22: "text"}


def test_each_document_is_one_row_with_its_head(done):
    rows = {(r["path"], r["title"]): (r["head"], r["archived"], r["status"], r["policy"], r["content_md"]) for r in done["documents"]}
    assert rows == {("/wiki/a.md", "A"): (11, False, "ready", "agent_editable", "one 2\n\nthree"), ("/wiki/b.md", "B"): (15, True, "archived", "locked", "b"), ("/wiki/b.md", "B2"): (18, False, "ready", "agent_editable", "new b\n\nmore"), ("/wiki/log.md", "L"): (20, False, "ready", "append_only", "entry"), ("/wiki/new.md", "N"): (22, False, "ready", "append_only", "text")}
    assert len({r["doc_id"] for r in done["documents"]}) == 5
    assert sorted((r["seq"], r["event_type"]) for r in done["activity"])[:3] == [(10, "document.updated"), (11, "document.updated"), (15, "document.archived")]


def test_a_commit_is_visible_whole_or_not_at_all(spark, tmp_path):
    log = journal.Journal(spark, f"file://{tmp_path}/log")
    one = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "doc_id long, head long, path string")
    assert log.commit({"documents": one, "revisions": one.selectExpr("head as revision_id", "path as content_md")}) == 1

    @F.udf("long")
    def breaks(x):
        raise ValueError("a task is lost")

    with pytest.raises(Exception, match="a task is lost"):
        log.commit({"documents": one.limit(1), "revisions": one.select(breaks("head").alias("revision_id"), F.col("path").alias("content_md"))})
    assert log.documents().count() == 2 and log.read("revisions").count() == 2
    assert log.commit({"documents": one.filter("doc_id = 2").withColumn("head", F.lit(9).cast("long")), "revisions": spark.createDataFrame([(9, "c")], "revision_id long, content_md string")}) == 2
    now = journal.with_heads(log.documents(), log.read("revisions"))
    assert {(r["doc_id"], r["head"], r["head_md"]) for r in now.collect()} == {(1, 5, "a"), (2, 9, "c")}
    assert {r["head"] for r in log.documents(upto=1).collect()} == {5, 6}
    with pytest.raises(ValueError, match="no commit"):
        log.read("steps")


def test_commits_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    folder, numbers = f"file://{tmp_path}/log", []
    rows = spark.range(3)
    some = [threading.Thread(target=lambda: numbers.append(journal.Journal(spark, folder).commit({"rows": rows}))) for _ in range(4)]
    for t in some:
        t.start()
    for t in some:
        t.join()
    assert sorted(numbers) == [1, 2, 3, 4] and journal.Journal(spark, folder).read("rows").groupBy("_commit").count().count() == 4


def test_commands_are_run_once_for_all_tables(spark):
    docs, commands = catalogue.K.documents(spark, "/root/testdata/sf0.001"), catalogue._commands(spark, "/root/testdata/sf0.001")
    kept, plain = (journal.run_commands(docs, commands, "2024-06-01 00:00:00", keep=k) for k in (True, False))
    for name, rows in kept.items():
        assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, plain[name].collect()))
