import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import compiling, documents, queueing
from tesserine.session import ENOUGH, spread
from tesserine.sources import files, notes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.slugify(F.lit("  Quarterly Notes!")), "quarterly-notes"),
        (lambda: T.slugify(F.lit("日本")), "item"),
        (lambda: T.replace_once(F.lit("hello world"), F.lit("world"), F.lit("vault")), "hello vault"),
        (lambda: T.replace_once(F.lit("same same"), F.lit("same"), F.lit("x")), "same same"),
        (lambda: T.append_markdown(F.lit("a\n\n"), F.lit(" b ")), "a\n\nb"),
        (lambda: T.append_markdown(F.lit("  "), F.lit("b")), "b"),
        (lambda: T.lines(F.lit("a\r\nb\n")), ["a", "b"]),
        (lambda: T.lines(F.lit("")), []),
        (lambda: T.page_range(F.lit("1-3, 7,2,x")), [1, 2, 3, 7]),
        (lambda: T.percent(F.lit(0.125)), "12%"),
        (lambda: T.token_count(F.lit("  ")), 0),
        (lambda: T.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y')), '{"a": 1}'),
        (lambda: T.highlight(F.lit("A.b a.B"), F.lit("a.b")), "**A.b** **a.B**"),
        (lambda: T.stem(F.lit("/x/notes.tar.md")), "notes.tar"),
    ],
)
def test_text(spark, column, want):
    assert value(spark, column()) == want


def test_heading_stack_is_cut_by_position(spark):
    docs = spark.createDataFrame([(1, "# a\n### b\n## c\ntext | x\n---"), (2, "### a\n## b"), (3, ""), (4, None)], "doc_id long, content_md string")
    got = {(r["doc_id"], r["chunk_idx"]): (r["block_type"], r["heading_path"]) for r in compiling.split_blocks(docs).collect()}
    assert got == {(1, 0): ("heading", ["a"]), (1, 1): ("heading", ["a", "b"]), (1, 2): ("heading", ["a", "c"]), (1, 3): ("table", ["a", "c"]), (2, 0): ("heading", ["a"]), (2, 1): ("heading", ["a", "b"])}


def test_line_diff(spark):
    df = spark.createDataFrame([("alpha\nbeta\ngamma", "alpha\nbeta-2\ngamma\ndelta")], "a string, b string")
    kinds = [x["type"] for x in df.select(documents.line_diff("a", "b").alias("d")).first()["d"]]
    assert kinds.count("added") == 2 and kinds.count("removed") == 1


def test_idempotent_enqueue_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 3000), ("a", 3700), ("b", 10)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["k"], r["s"]) for r in queueing.accepted(rows, ["k"], "ts").collect()) == [("a", 0), ("a", 3700), ("b", 10)]


def test_files_become_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.html").write_text("<p>Hi <b>you</b><script>no()</script>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>one</w:t></w:p><w:p><w:t> </w:t></w:p></w:document>')
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    got = {r["title"]: r["text"] for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a": "# T\n", "b": "| x | y |\n| --- | --- |\n| 1 | 2 |", "c": "Hi\nyou", "d": "one"}


def test_uploads_are_checked(spark):
    def office(*names):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return data.getvalue()

    rows = [
        ("a.exe", b"MZ", None, "suffix"), ("noname", b"x", None, "suffix"), ("a.pdf", b"%PDF-1", None, None), ("b.pdf", b"%PDF", None, "not a pdf"), ("c.pdf", b"%PDF-1", "image/png", "media type"), ("d.PDF", b"%PDF-1", " Application/PDF ; x=1", None),
        ("a.txt", b"a\x00b", None, "not text"), ("b.txt", b"\xff\xfe", None, "not text"), ("c.txt", b"", "text/plain", None), ("d.md", "é".encode() * 3000, None, None), ("e.md", b"x" + "é".encode() * 3000, None, None), ("f.csv", b"x" * 4090 + b"\xff" * 10, None, "not text"), ("g.csv", b"x" * 4096 + b"\xff", None, None),
        ("a.docx", b"PK\x03\x04", None, "not an office file"), ("b.docx", office("word/document.xml"), None, None), ("c.docx", office("xl/workbook.xml"), None, "not an office file"), ("d.xlsx", office("[Content_Types].xml", "xl/workbook.xml"), None, None), ("e.pptx", office("keyword/x"), None, "not an office file"),
        ("a.doc", bytes.fromhex("D0CF11E0A1B11AE100"), None, None), ("b.xls", b"PK", None, "not an office file"), ("a.html", b"<!DOCTYPE HTML><p>x", None, None), ("b.htm", b"<p>x</p>", None, "not html"), ("c.html", b"<BODY>\xff", None, "not text"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "name string, content binary, media string")
    got = {r["name"]: r["e"] for r in df.select("name", files.upload_error(F.col("name"), F.col("content"), F.col("media")).alias("e")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_media_types_and_paths(spark):
    names = spark.createDataFrame([("/x/a.PDF",), ("b.unknown",), ("c",)], "n string")
    assert [r["m"] for r in names.select(files.media_type(F.col("n")).alias("m")).collect()] == ["application/pdf", "application/octet-stream", "application/octet-stream"]
    paths = spark.createDataFrame([(" wiki/a.md ", "wiki"), ("/a/", "wiki"), ("", "wiki"), ("/a", "wiki"), ("/a", "source")], "p string, k string")
    path, error = documents.normalised_path(F.col("p"), F.col("k"))
    assert [tuple(r) for r in paths.select(path, error).collect()] == [("/wiki/a.md", None), ("/a/", "ends with a slash"), ("/", "empty"), ("/a", "not markdown"), ("/a", None)]


def test_notes_source(spark, tmp_path):
    rich = lambda t: {"rich_text": [{"plain_text": t}]}
    page = {"id": "1", "properties": {"Name": {"type": "title", "title": [{"plain_text": "T"}]}}, "children": [{"type": "heading_2", "heading_2": rich("h")}, {"type": "to_do", "to_do": {**rich("x"), "checked": True}}, {"type": "table_of_contents"}]}
    (tmp_path / "n.json").write_text(json.dumps({"results": [page]}))
    spark.dataSource.register(notes.NotesSource)
    assert [tuple(r) for r in spark.read.format("notes").option("files", str(tmp_path / "n.json")).load().collect()] == [("1", "T", "## h\n\n- [x] x")]


def test_graph_flags_and_focus(spark):
    from tesserine.operators import graph

    t = {
        "documents": spark.createDataFrame([(1, "/wiki/a.md", "A", "wiki"), (2, "/wiki/overview.md", "O", "system"), (3, "/wiki/c.md", "C", "wiki"), (4, "/wiki/d.md", "D", "wiki")], "doc_id long, path string, title string, kind string"),
        "entities": spark.createDataFrame([(5, "E", "person")], "entity_id long, title string, entity_type string"),
        "relations": spark.createDataFrame([(5, 5, "self", 1)], "source_entity_id long, target_entity_id long, relation_type string, source_document_id long"),
        "claims": spark.createDataFrame([(6, 5, "a claim")], "claim_id long, entity_id long, canonical_text string"),
        "citations": spark.createDataFrame([(6, 1), (6, 2)], "claim_id long, source_document_id long"),
        "references": spark.createDataFrame([(1, 3, "related"), (2, 3, "related")], "source_document_id long, target_document_id long, ref_type string"),
    }
    ids = lambda found: {r["id"] for r in found.nodes.collect()}
    labels = lambda found: sorted(r["label"] for r in found.edges.collect())
    whole = graph.workspace_graph(t)
    assert ids(whole) == {"entity:5", "claim:6", "document:1", "document:3"} and labels(whole) == ["cites", "related", "self", "supports"]
    assert ids(graph.workspace_graph(t, include_claims=False)) == {"entity:5", "document:1", "document:3"}
    assert labels(graph.workspace_graph(t, include_documents=False)) == ["self", "supports"]
    assert labels(graph.workspace_graph(t, include_references=False)) == ["cites", "self", "supports"]
    alone = graph.focus_graph(t, spark.createDataFrame([(4,)], "doc_id long"))
    assert ids(alone) == {"document:4"} and labels(alone) == []
    near = graph.focus_graph(t, spark.createDataFrame([(1,)], "doc_id long")).nodes.collect()
    assert near[0]["id"] == "document:1" and {r["id"] for r in near} == {"document:1", "entity:5", "claim:6", "document:3"}


def test_claims_and_blocks_after_a_second_ingest(spark):
    from tesserine.operators import compiling, writing

    old = spark.createDataFrame([(1, 0, "a", "h0"), (1, 1, "b", "h1"), (1, 2, "c", "h2"), (1, None, "x", None), (2, 0, "d", "h3")], "doc_id long, chunk_idx int, text string, content_hash string")
    new = spark.createDataFrame([(1, 0, "a2", "h0"), (1, 1, "B", "H1")], "doc_id long, chunk_idx int, text string, content_hash string")
    got = {(r["doc_id"], r["chunk_idx"], r["text"], r["written"]) for r in writing.apply_blocks(old, new, new).collect()}
    assert got == {(1, 0, "a", False), (1, 1, "B", True), (2, 0, "d", False)}
    claims = spark.createDataFrame([(7, 1, "b b"), (8, 1, None), (9, 1, "zzz")], "claim_id long, doc_id long, quote string")
    cited = {r["claim_id"]: (r["chunk_idx"], r["quote_text"], r["precision"]) for r in compiling.cite_claims(claims, old.filter("chunk_idx is not null")).collect()}
    assert cited == {7: (1, "b b", "exact_match"), 8: (0, "a", "fallback"), 9: (0, "zzz", "exact_match")}


def test_rerank_by_a_scorer(spark):
    from tesserine.operators import search

    hits = spark.createDataFrame([(f"h{i}", i, float(10 - i)) for i in range(1, 6)], "id string, position int, score double")
    scored = search.rerank(hits, "q", lambda df, q: df.select("id", F.col("position").cast("double").alias("score")), head=3)
    assert [r["id"] for r in scored.orderBy("position").collect()] == ["h3", "h2", "h1", "h4", "h5"]


def test_bucket_quantiles(spark):
    from tesserine.operators import queueing

    rows = [("a", float(v)) for v in range(1, 101)] + [("b", 5000.0)]
    got = {r["k"]: r["quantile"] for r in queueing.bucket_quantile(spark.createDataFrame(rows, "k string, v double"), "k", "v", [10, 50, 200], 0.95).collect()}
    assert got == {"a": 185.0, "b": 200.0}


def test_reclaim_and_idle(spark):
    from tesserine.operators import queueing

    runs = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "running"), (2, 1, "2024-01-01 00:00:30", "running"), (3, 1, "2024-01-01 00:00:01", "failed"), (3, 2, "2024-01-01 00:00:02", "failed"), (3, 3, "2024-01-01 00:00:03", "running")], "run_id long, seq long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [tuple(r) for r in queueing.reclaim(runs, "2024-01-01 00:01:10").select("run_id", "attempts", "route").collect()]
    assert got == [(1, 1, "retry"), (3, 3, "dead")]
    assert [r["run_id"] for r in queueing.reclaim(runs, "2024-01-01 00:01:10", locked=spark.createDataFrame([(1,)], "run_id long")).collect()] == [3]
    assert {r["run_id"] for r in queueing.idle(runs, "2024-01-01 00:01:10").collect()} == {1, 3}


def test_first_seen_opens_again_after_its_time(spark, tmp_path):
    """Batches an hour and more apart: a key is dropped within the time and let through after it."""
    from tesserine.streaming import queue

    schema = "k string, ts timestamp"
    for i, rows in enumerate(([("a", "2024-01-01 00:00:00")], [("a", "2024-01-01 00:30:00")], [("z", "2024-01-02 00:00:00")], [("y", "2024-01-02 00:05:00")], [("a", "2024-01-02 00:10:00")])):
        df = spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = queue.first_seen(stream, ["k"], "ts").writeStream.foreachBatch(lambda b, _: out.extend((r["k"], str(r["ts"])) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out) == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:10:00"), ("y", "2024-01-02 00:05:00"), ("z", "2024-01-02 00:00:00")]


def test_files_that_need_a_converter_say_so(spark, tmp_path):
    from tesserine.sources import files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 \x00\x01\xff")
    (tmp_path / "b.txt").write_text("plain")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (None, "needs a converter"), "b.txt": ("plain", None)}


def test_lines_become_paragraphs(spark):
    from tesserine.operators import compiling

    rows = [(1, 1, 10.0, 1.0, 50.0, 12.0, "one"), (1, 1, 12.0, 1.0, 60.0, 14.0, "two"), (1, 1, 40.0, 2.0, 30.0, 42.0, "three"), (1, 2, 5.0, 1.0, 9.0, 6.0, "four")]
    got = compiling.lines_to_paragraphs(spark.createDataFrame(rows, "doc_id long, page_no int, top double, left double, right double, bottom double, text string")).collect()
    assert sorted((r["page_no"], r["text"], r["right"]) for r in got) == [(1, "one two", 60.0), (1, "three", 30.0), (2, "four", 9.0)]


def test_words_are_counted_like_tokens(spark):
    texts = ["The the theme _the the_ (the) blathe the", "the", "thethe", "the the", "Äthe the-the thé 7the", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.count_of(F.col("t"), "the").alias("n"), F.size(F.filter(T.tokens(F.col("t")), lambda x: x == "the")).alias("want"))
    got = rows.collect()
    assert [r["n"] for r in got if r["t"] is not None] == [r["want"] for r in got if r["t"] is not None] and got[0]["n"] == 4


def test_only_small_tables_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.range(0, 100, 1, 64)
    assert spread(one).rdd.getNumPartitions() == min(ENOUGH, cores) and spread(one).count() == 100
    assert spread(many) is many
