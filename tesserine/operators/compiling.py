"""From markdown to blocks, entities, claims, relations, citations and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as T
from tesserine.tables import ENTITY_KINDS


def split_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(F.col("content_md"))).alias("pos", "line"))


def split_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, content_md -> chunk_idx, block_type, heading_path, text, token_count, content_hash.

    A line that begins with ``#`` is a heading, blank lines end a paragraph.  The
    path keeps the first level - 1 headings of the path before and adds the new one.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = split_lines(docs).withColumn("heading", F.col("line").startswith("#")).withColumn("blank", T.trim(F.col("line")) == "")
    rows = rows.withColumns({"part": F.sum((F.col("heading") | F.col("blank")).cast("int")).over(order), "nth": F.sum(F.col("heading").cast("int")).over(order)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    parts = rows.filter("heading or not blank").groupBy("doc_id", "part", "nth", "heading").agg(F.min("pos").alias("pos"), joined.alias("text"))
    mark = F.regexp_extract("text", "^#+", 0)
    parts = parts.withColumn("level", F.when(F.col("heading"), F.length(mark))).withColumn("text", F.when(F.col("heading"), T.trim(F.regexp_replace("text", "^#+", ""))).otherwise(T.trim(F.col("text"))))
    stack = parts.filter("heading").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "level", "text"))).alias("h"))

    def push(acc: Column, x: Column) -> Column:
        path = F.concat(F.slice(acc["now"], F.lit(1), F.greatest(x["level"] - 1, F.lit(0))), F.array(x["text"]))
        return F.struct(path.alias("now"), F.concat(acc["all"], F.array(F.struct(x["nth"].alias("nth"), path.alias("path")))).alias("all"))

    start = F.expr("struct(cast(array() as array<string>) as now, cast(array() as array<struct<nth:bigint,path:array<string>>>) as all)")
    paths = stack.select("doc_id", F.explode(F.aggregate("h", start, push)["all"]).alias("p")).select("doc_id", "p.nth", "p.path")
    out = parts.join(paths, ["doc_id", "nth"], "left").filter("heading or text <> ''")
    kind = F.when(F.col("heading"), "heading").when(F.contains("text", F.lit("|")) & F.contains("text", F.lit("---")), "table").otherwise("paragraph")
    return out.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("chunk_idx"),
        kind.alias("block_type"),
        F.coalesce("path", F.array().cast("array<string>")).alias("heading_path"),
        "text",
        T.token_count(F.col("text")).alias("token_count"),
        F.sha2("text", 256).alias("content_hash"),
    )


def block_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, action: what a re-ingest does with each block."""
    a, b = old.select("doc_id", "chunk_idx", F.col("content_hash").alias("was")), new.select("doc_id", "chunk_idx", F.col("content_hash").alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "unchanged").otherwise("update")
    return a.join(b, ["doc_id", "chunk_idx"], "full").select("doc_id", "chunk_idx", action.alias("action"))


def sections(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, text: the sections of these titles, each to the next heading of any level, in order, joined by a blank line."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = split_lines(docs).withColumn("heading", F.col("line").startswith("#"))
    title = F.lower(T.trim(F.regexp_replace("line", "^#+", "")))
    rows = rows.withColumn("title", F.last(F.when(F.col("heading"), title), ignorenulls=True).over(order)).withColumn("nth", F.sum(F.col("heading").cast("int")).over(order))
    rows = rows.filter(F.col("title").isin(*[n.lower().strip() for n in names if n.strip()]))
    joined = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]]), "\n")
    chunk = rows.groupBy("doc_id", "nth").agg(T.trim(joined("pos", "line")).alias("chunk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk"))), lambda x: x["chunk"])
    return chunk.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def render_table(rows: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """One markdown table per group."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |"
    return rows.groupBy(group).agg(F.concat_ws("\n", F.lit(head), body).alias("table_md"))


def upsert_entities(rows: DataFrame, order: str) -> DataFrame:
    """One entity per slug: the longest title (the latest of equals), the longest summary (the earliest), the last type."""
    rows = rows.withColumn("slug", T.slugify(F.col("title")))
    n, i = F.length, F.col(order)
    return rows.groupBy("slug").agg(
        F.max_by("title", F.struct(n("title"), i)).alias("title"),
        F.max_by("entity_type", i).alias("entity_type"),
        F.max_by("summary", F.struct(n("summary"), -i)).alias("summary"),
    )


def provenance(relations: DataFrame) -> DataFrame:
    """The documents of each relation, one row each: a relation with very many documents is many rows, no long list."""
    return relations.select("source_entity_id", "target_entity_id", "relation_type", "source_document_id").distinct()


def without_documents(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Provenance after the documents of ``gone`` (source_document_id) are taken out; relations without any go."""
    return provenance(relations).join(gone, "source_document_id", "left_anti")


def relation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_entity_id", "target_entity_id", "relation_type").agg(F.count("*").alias("documents"), F.min("source_document_id").alias("first_document"), F.max("source_document_id").alias("last_document"))


def accept_claims(claims: DataFrame, least: float) -> DataFrame:
    """Confidence clamped to 0..1, then the threshold."""
    return claims.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).filter(F.col("confidence") >= least)


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def match_quotes(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """claim_id, doc_id, quote x doc_id, chunk_idx, text -> the block that holds most of the quote's first ten words, the earliest of equals."""
    words = F.slice(T.words(F.lower("quote")), 1, 10)
    both = citations.select("claim_id", "doc_id", words.alias("w")).join(blocks.select("doc_id", "chunk_idx", F.lower("text").alias("t")), "doc_id")
    hits = F.size(F.filter("w", lambda x: F.contains(F.col("t"), x)))
    best = both.withColumn("hits", hits).filter("hits > 0").groupBy("claim_id", "doc_id").agg(F.max(F.struct("hits", -F.col("chunk_idx"))).alias("b"))
    return best.select("claim_id", "doc_id", (-F.col("b")["col2"]).alias("chunk_idx"), F.col("b.hits").alias("overlap"))


def cite_claims(claims: DataFrame, blocks: DataFrame, most: int = 400) -> DataFrame:
    """claim_id, doc_id, quote (may be null) -> chunk_idx, quote_text, precision.

    A claim is cited by the block that its quote fits best, by the first block of the
    document if none fits; without a quote the first block's text stands for it.
    """
    quote = F.nullif("quote", F.lit(""))
    best = match_quotes(claims.filter(quote.isNotNull()), blocks).select("claim_id", "doc_id", "chunk_idx")
    first = blocks.groupBy("doc_id").agg(F.min(F.struct("chunk_idx", F.left("text", F.lit(most)).alias("text"))).alias("b"))
    found = claims.join(best, ["claim_id", "doc_id"], "left").join(first, "doc_id", "left")
    return found.select("claim_id", "doc_id", F.coalesce("chunk_idx", "b.chunk_idx").alias("chunk_idx"), F.coalesce(F.left(quote, F.lit(most)), "b.text").alias("quote_text"), F.when(quote.isNotNull(), "exact_match").otherwise("fallback").alias("precision"))


def match_paragraphs(blocks: DataFrame, paragraphs: DataFrame, words: int = 15, least: int = 3) -> DataFrame:
    """doc_id, chunk_idx, text x doc_id, para_no, text -> the paragraph that shares most of the first words, the earliest of equals, ``least`` at least."""
    head = lambda c: F.array_distinct(F.slice(T.words(F.lower(c)), 1, words))
    both = blocks.select("doc_id", "chunk_idx", head("text").alias("a")).join(paragraphs.select("doc_id", "para_no", head("text").alias("b")), "doc_id")
    shared = both.withColumn("overlap", F.size(F.array_intersect("a", "b"))).filter(F.col("overlap") >= least)
    best = shared.groupBy("doc_id", "chunk_idx").agg(F.max(F.struct("overlap", -F.col("para_no"))).alias("m"))
    return best.select("doc_id", "chunk_idx", (-F.col("m")["col2"]).alias("para_no"), F.col("m.overlap").alias("overlap"))


def purge(rows: DataFrame, citations: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims without those that a document of ``gone`` (source_document_id) is cited for."""
    return rows.join(citations.join(gone, "source_document_id", "left_semi").select("claim_id"), "claim_id", "left_anti")


def pages(entities: DataFrame, claims: DataFrame, relations: DataFrame, source: str) -> DataFrame:
    """path, content_md: one page per entity with claims: summary, snapshot, diagram, evidence."""
    line = F.concat(F.lit("- "), "canonical_text", F.lit(" (confidence: "), T.percent(F.col("confidence")), F.lit(")"))
    evidence = claims.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("md")))), lambda x: x["md"]), "\n").alias("evidence"))
    named = entities.select("entity_id", "title")
    # the arrow is always drawn from the page's own entity
    a = relations.select(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other"), "relation_type")
    b = relations.select(F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("other"), "relation_type")
    ends = a.unionByName(b).join(claims.select("entity_id").distinct(), "entity_id", "left_semi").distinct()
    drawn = ends.join(named.select(F.col("entity_id").alias("other"), F.col("title").alias("other_title")), "other")
    edge = F.concat(F.lit("  this -->|"), F.replace("relation_type", F.lit("|"), F.lit("/")), F.lit('| "'), T.escape_label(F.col("other_title")), F.lit('"'))
    diagram = drawn.select("entity_id", edge.alias("edge")).distinct().groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("edge")), "\n").alias("edges"))
    folder = F.when(F.col("entity_type").isin(*ENTITY_KINDS), "entities").otherwise("concepts")
    body = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), "summary", F.lit("\n\n| Type | Source |\n| --- | --- |\n| "), "entity_type", F.lit(f" | {source} |\n\n```mermaid\ngraph LR\n"),
        F.coalesce("edges", F.lit("  this --> source")), F.lit("\n```\n\n## Evidence\n\n"), F.coalesce("evidence", F.concat(F.lit("- "), "summary")),
    )
    out = entities.join(evidence, "entity_id").join(diagram, "entity_id", "left")
    return out.select("entity_id", F.concat(F.lit("/wiki/"), folder, F.lit("/"), T.slugify(F.col("title")), F.lit(".md")).alias("path"), body.alias("content_md"))


def change_plan(docs: DataFrame, entities: DataFrame, claims: DataFrame, relations: DataFrame, blocks: DataFrame, date: str) -> DataFrame:
    """doc_id, nth, op, path, title, content, reason: what the compiler writes for each document; the log entry comes last.

    docs: doc_id, title, workspace, pages (how many it has).  entities, claims and relations as the cleaning
    leaves them, in the order of ``nth``; blocks: doc_id, chunk_idx, page_no, text.
    Each claim is evidence with a footnote to the page of the block that its quote fits
    best, or to the first page with text.
    """
    d = docs.select("doc_id", F.col("title").alias("source"), "workspace", "pages")
    first = blocks.filter(T.trim(F.col("text")) != "").groupBy("doc_id").agg(F.min_by("page_no", "chunk_idx").alias("_first"))
    d = d.join(first, "doc_id", "left").withColumn("latest", F.coalesce("_first", F.lit(1)).cast("int")).drop("_first")
    node = lambda slug, label: F.concat(slug, F.lit('["'), T.escape_label(label), F.lit('"]'))
    joined = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")

    quoted = claims.withColumn("claim_id", F.col("nth")).filter("quote <> ''").select("claim_id", "doc_id", "quote")
    best = match_quotes(quoted, blocks).join(blocks.select("doc_id", "chunk_idx", F.col("page_no").alias("_page")), ["doc_id", "chunk_idx"]).select("doc_id", F.col("claim_id").alias("nth"), "_page")
    cited = claims.join(best, ["doc_id", "nth"], "left").join(d.select("doc_id", "latest"), "doc_id").withColumn("page", F.coalesce("_page", "latest").cast("int"))
    line = F.concat(F.lit("- "), "text", F.lit(" (confidence: "), T.percent(F.col("confidence")), F.lit(")[^"), F.col("page").cast("string"), F.lit("]"))
    evidence = cited.groupBy("doc_id", F.col("entity_title").alias("title")).agg(joined(["nth"], line).alias("evidence"), F.array_sort(F.collect_set("page")).alias("noted"))

    ends = relations.select("doc_id", "nth", F.lit(0).alias("end"), F.col("source_title").alias("title"), F.col("target_title").alias("other"), "relation_type").unionByName(relations.select("doc_id", "nth", F.lit(1).alias("end"), F.col("target_title").alias("title"), F.col("source_title").alias("other"), "relation_type"))
    arrow = F.concat(F.lit(" -->|"), F.replace("relation_type", F.lit("|"), F.lit("/")), F.lit("| "), node(T.slugify(F.col("other")), F.col("other")))
    mine = F.concat(F.lit("    "), node(F.col("slug"), F.col("title")))
    drawn = ends.join(entities.select("doc_id", "title", "slug"), ["doc_id", "title"]).groupBy("doc_id", "title").agg(joined(["nth", "end"], F.concat(mine, arrow)).alias("arrows"))

    rows = entities.join(d, "doc_id").join(evidence, ["doc_id", "title"], "left").join(drawn, ["doc_id", "title"], "left")
    # The page's headings, its table and the diagram of a page without relations.
    alone = F.concat(F.lit("    "), node(F.concat(F.lit("source-"), T.slugify(F.col("source"))), F.col("source")), F.lit(" --> "), node(F.col("slug"), F.col("title")), F.lit("\n"), mine, F.lit(" --> "), node(F.lit("compiled-wiki"), F.lit("Compiled Wiki")))
    noted = F.coalesce("noted", F.array("latest"))
    notes = F.array_join(F.transform(noted, lambda p: F.concat(F.lit("[^"), p.cast("string"), F.lit("]: "), F.col("source"), F.lit(", p."), p.cast("string"))), "\n")
    content = F.concat(
        "summary", F.lit("\n\n## Snapshot\n\n| Attribute | Value |\n| --- | --- |\n| Type | "), "entity_type", F.lit(" |\n| Source | "), "source", F.lit(" |\n| Workspace | "), "workspace", F.lit(" |\n\n```mermaid\ngraph TD\n"),
        F.coalesce("arrows", alone), F.lit("\n```\n\n## Evidence\n\n"), F.coalesce("evidence", F.concat("summary", F.lit("[^"), F.col("latest").cast("string"), F.lit("]"))), F.lit("\n\n"), notes, F.lit("\n"),
    )
    folder = F.when(F.col("entity_type").isin(*ENTITY_KINDS), "entities").otherwise("concepts")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth")).cast("long")
    pages = rows.select("doc_id", order.alias("nth"), F.lit("create_doc").alias("op"), F.concat(F.lit("/wiki/"), folder, F.lit("/"), "slug", F.lit(".md")).alias("path"), "title", content.alias("content"), F.concat(F.lit("Compile "), "entity_type", F.lit(" from source "), "source").alias("reason"))

    log = d
    for name, table in (("entities", entities), ("claims", claims), ("relations", relations)):
        log = log.join(table.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    entry = F.concat(F.lit(f"## [{date}] ingest | "), "source", F.lit("\n- Parsed "), n("pages"), F.lit(" page(s)\n- Extracted "), n("entities"), F.lit(" entities, "), n("claims"), F.lit(" claims, "), n("relations"), F.lit(" relations\n- Updated overview and compiled wiki pages\n"))
    logged = log.select("doc_id", (F.coalesce("entities", F.lit(0)) + 1).alias("nth"), F.lit("append_content").alias("op"), F.lit("/wiki/log.md").alias("path"), F.lit("Log").alias("title"), entry.alias("content"), F.concat(F.lit("Append ingest log for "), "source").alias("reason"))
    return pages.unionByName(logged)


def unique_slugs(names: DataFrame, name: str, order: str) -> DataFrame:
    """slug: the base slug, with -2, -3, ... for later rows of the same one."""
    base = T.slugify(F.col(name), "workspace")
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return names.withColumn("_base", base).withColumn("slug", F.when(n > 1, F.concat("_base", F.lit("-"), n.cast("string"))).otherwise(F.col("_base"))).drop("_base")


def lines_to_paragraphs(lines: DataFrame, gap: float = 5.0) -> DataFrame:
    """Printed lines (page_no, top, left, right, bottom, text) to paragraphs: a new one where the top moves by more than ``gap``."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("top", "left")
    moved = F.coalesce((F.col("top") - F.lag("top").over(order) > gap).cast("int"), F.lit(0))
    rows = lines.withColumn("_moved", moved).withColumn("part", F.sum("_moved").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "page_no", "part").agg(text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def compile_documents(docs: DataFrame, date: str, extract: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]] | None = None, header: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.5) -> dict[str, DataFrame]:
    """Blocks, entities, claims, relations and the change plan of markdown documents (doc_id, title, workspace, content_md).

    ``extract`` maps blocks and titles to raw entities, claims and relations (see ``extracting``; without
    one the extractor that needs no model); ``header`` may add a column context_header to the
    blocks.  Models live in these two.
    """
    from tesserine.operators import extracting

    blocks = split_blocks(docs).withColumn("page_no", F.lit(1))
    blocks = header(blocks) if header else blocks.withColumn("context_header", F.lit(None).cast("string"))
    blocks = blocks.withColumn("embed_text", F.concat_ws("\n\n", "context_header", "text"))
    raw = (extract or extracting.extract)(blocks, docs.select("doc_id", "title"))
    entities, claims, relations = extracting.clean_entities(raw[0]), extracting.clean_claims(raw[1], least), extracting.clean_relations(raw[2])
    plan = change_plan(docs.select("doc_id", "title", "workspace", F.lit(1).alias("pages")), entities, claims, relations, blocks, date)
    return {"blocks": blocks, "entities": entities, "claims": claims, "relations": relations, "plan": plan}
