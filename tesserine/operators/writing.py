"""The write side as set operations: what tables hold after a batch of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators.scans import WIDTH, running


def apply_blocks(old: DataFrame, fresh: DataFrame, ingested: DataFrame) -> DataFrame:
    """Blocks after a re-ingest of the documents of ``ingested`` (doc_id): doc_id, chunk_idx, content_hash and all other columns of both, and ``written``.

    Blocks of equal hash stay as they are, others are overwritten or added, places
    that are gone are deleted, and so are blocks without a place.  A document that
    is ingested and has no block in ``fresh`` loses all; documents that are not ingested keep theirs.
    """
    ingested = ingested.select("doc_id").distinct()
    kept = old.join(ingested, "doc_id", "left_anti").withColumn("written", F.lit(False))
    was = old.filter("chunk_idx is not null").join(ingested, "doc_id", "left_semi")
    rest = [c for c in fresh.columns if c not in ("doc_id", "chunk_idx")]
    now = fresh.join(ingested, "doc_id", "left_semi")
    both = now.join(was.select("doc_id", "chunk_idx", *[F.col(c).alias(f"_{c}") for c in rest]), ["doc_id", "chunk_idx"], "left")
    same = F.coalesce(F.col("content_hash") == F.col("_content_hash"), F.lit(False))
    now = both.select("doc_id", "chunk_idx", *[F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest], (~same).alias("written"))
    return kept.unionByName(now)


def replace_pages(old: DataFrame, fresh: DataFrame, ingested: DataFrame) -> DataFrame:
    """All pages of the documents of ``ingested`` (doc_id) give way to those of ``fresh``, also where there are none."""
    ingested = ingested.select("doc_id").distinct()
    return old.join(ingested, "doc_id", "left_anti").unionByName(fresh.join(ingested, "doc_id", "left_semi"))


def upsert_references(rows: DataFrame, order: str) -> DataFrame:
    """One row for each source, target and type; the metadata written last stays."""
    return rows.groupBy("source_document_id", "target_document_id", "ref_type").agg(F.max_by("metadata", F.col(order)).alias("metadata"))


def update_runs(changes: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Runs after partial updates in order: null leaves a column as it is, the start is set once, the end each time.

    changes: key, at, seq, status, output, error_message, started_now, completed_now.
    """
    order = F.struct(at, seq)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return changes.groupBy(key).agg(last("status"), last("output"), last("error_message"), F.min(F.when(F.col("started_now"), F.col(at))).alias("started_at"), F.max(F.when(F.col("completed_now"), F.col(at))).alias("completed_at"))


def page_pieces(documents: DataFrame, actions: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The revisions that the compiler's actions make, and the pieces that their texts are made of.

    actions: seq (a number that a path has once), path, title, op (append_content, or any
    other for a new content), content (null counts as empty), reason.  A path without a live
    document becomes a wiki page whose id is the hash of the path; its first action makes the content.

    revisions: doc_id, path, seq, op, title, reason, created, segment, upto.
    pieces: path, segment, nth, base, text.  A new content opens a segment and is its base, what is
    appended afterwards is a piece.  The text of a revision is the base of its segment and
    the pieces of that segment up to number ``upto``: nothing is written twice, so the work
    grows with the actions and not with their square.
    """
    live = documents.filter(~F.col("archived")).select("path", "doc_id", "content_md")
    met = actions.groupBy("path").agg(F.min("seq").alias("_first")).join(live, "path", "left")
    met = met.select("path", "_first", "content_md", F.col("doc_id").isNull().alias("created"), F.coalesce("doc_id", F.xxhash64("path")).alias("doc_id"))
    content, first = F.coalesce("content", F.lit("")), F.col("seq") == F.col("_first")
    rewrites = (F.col("op") != "append_content") | (F.col("created") & first)
    rows = actions.join(met.drop("content_md"), "path").withColumns({"base": rewrites, "text": F.when(rewrites, content).otherwise(T.trim(content))})
    adds = ~F.col("base") & (F.col("text") != "")
    rows = running(rows.withColumn("created", F.col("created") & first), ["path"], "seq", {"segment": F.col("base"), "upto": adds}, width)
    revisions = rows.select("doc_id", "path", "seq", "op", "title", "reason", "created", "segment", "upto")
    added = rows.filter(F.col("base") | adds).select("path", "segment", F.col("upto").alias("nth"), "base", "text")
    before = met.filter(~F.col("created")).select("path", F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("nth"), F.lit(True).alias("base"), F.coalesce("content_md", F.lit("")).alias("text"))
    return revisions, before.unionByName(added)


def revision_texts(revisions: DataFrame, pieces: DataFrame) -> DataFrame:
    """``revisions`` (with path, segment, upto) with their content_md, put together from ``pieces``.

    Meant for the revisions that are wanted: each text is written in full.
    """
    keys = revisions.columns
    both = revisions.join(pieces.withColumnRenamed("segment", "_segment").withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & (F.col("segment") == F.col("_segment")) & (F.col("base") | (F.col("nth") <= F.col("upto"))))
    piece = F.when(~F.col("base"), F.struct("nth", "text"))
    grouped = both.groupBy(*keys).agg(F.max(F.when(F.col("base"), F.col("text"))).alias("_base"), F.collect_list(piece).alias("_more"))
    more = F.array_join(F.transform(F.array_sort("_more"), lambda x: x["text"]), "\n\n")
    return grouped.select(*keys, F.when(F.size("_more") == 0, F.col("_base")).otherwise(T.append_markdown(F.col("_base"), more)).alias("content_md"))


def apply_actions(documents: DataFrame, actions: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, new revisions and their pieces after the compiler's actions; it writes whatever the policy says.

    See ``page_pieces``.  Every action makes a revision; the last one of a path is the
    head, whose text is put together from its pieces: one page's content is one row.
    """
    revisions, pieces = page_pieces(documents, actions, width)
    last = revisions.groupBy("path").agg(F.max_by(F.struct("doc_id", "title", "segment", "upto"), "seq").alias("h"), F.max("created").alias("created"))
    heads = revision_texts(last.select("path", "h.*", "created"), pieces).withColumnsRenamed({"content_md": "_head", "title": "_title"})
    changed = documents.join(heads.filter(~F.col("created")).select("doc_id", "_head"), "doc_id", "left").withColumn("content_md", F.coalesce("_head", "content_md")).select(*documents.columns)
    fixed = {"kind": F.lit("wiki"), "policy": F.lit("system_managed"), "archived": F.lit(False), "content_md": F.col("_head"), "title": F.col("_title")}
    new = heads.filter("created").select(*[(fixed.get(c, F.col(c) if c in ("path", "doc_id") else F.lit(None))).cast(documents.schema[c].dataType).alias(c) for c in documents.columns])
    return changed.unionByName(new), revisions, pieces


def overview(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """workspace_id, content_md, sources, pages: the overview page of each workspace that ``updates`` has a row for.

    updates: workspace_id, title (of the source ingested last), nodes and pages (how many the
    ingest extracted, and wrote).  The counts are of live documents.
    """
    live = documents.filter(~F.col("archived"))
    n = live.groupBy("workspace_id").agg(F.count_if(F.col("kind") == "source").alias("sources"), F.count_if(F.col("kind").isin("wiki", "system")).alias("pages"))
    both = updates.withColumnRenamed("pages", "_written").join(n, "workspace_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sources", "pages")})
    node = lambda name, label: F.concat(name, F.lit('["'), T.escape_label(label), F.lit('"]'))
    # The page's sentences, its table, and the nodes of its diagram in order.
    source = node(F.concat(F.lit("source-"), T.slugify(F.col("title"))), F.col("title"))
    compiler, wiki, hybrid, agent = (node(F.lit(a), F.lit(b)) for a, b in (("compiler", "Compiler"), ("compiled-wiki", "Compiled Wiki"), ("hybrid-search", "Hybrid Search"), ("agent-plane", "Agent Operating Plane")))
    arrows = [F.concat(F.lit("    "), a, F.lit(" --> "), b) for a, b in ((source, compiler), (compiler, wiki), (wiki, hybrid), (wiki, agent))]
    text = F.concat_ws(
        "\n",
        F.lit("This workspace is an agent-native compiled knowledge vault.\n\n## Key Findings\n\n| Signal | Value |\n| --- | --- |"),
        F.format_string("| Sources | %d |", "sources"), F.format_string("| Wiki Pages | %d |", "pages"), F.concat(F.lit("| Latest Source | "), "title", F.lit(" |")),
        F.lit("\n```mermaid\ngraph TD"), *arrows, F.lit("```\n\n## Recent Updates\n"),
        F.concat(F.lit("- Processed source `"), "title", F.lit("`.")), F.format_string("- Extracted %d semantic nodes.", "nodes"), F.format_string("- Created or updated %d wiki documents.\n", "_written"),
    )
    return both.select("workspace_id", text.alias("content_md"), "sources", "pages")


def run_steps(run_id: Column, done: list[str], failed: str | None = None) -> Column:
    """The journal steps of a run as an array: those done, and the one that failed."""
    rows = [F.struct(run_id.alias("run_id"), F.lit(k).alias("step_key"), F.lit("succeeded").alias("status")) for k in done]
    if failed:
        rows.append(F.struct(run_id.alias("run_id"), F.lit(failed).alias("step_key"), F.lit("failed").alias("status")))
    return F.array(*rows)
