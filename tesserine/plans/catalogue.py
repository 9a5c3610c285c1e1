"""Named queries over the test tables and their SQL counterparts.

Each entry is (name, Spark query, SQL); SQL is None where there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine import tables as K
from tesserine.functions import text as T
from tesserine.functions import vectors as V
from tesserine.operators import compiling, documents, extracting, fulltext, graph, journal, neighbours, queueing, reading, search, writing
from tesserine.session import spread
from tesserine.sinks import folder, stored
from tesserine.streaming import queue
from tesserine.streaming import runs as lives

QUERY, WORD, LIMIT = "the that", "the", 20
AS_OF = "2024-06-01 00:00:00"
BUCKETS = (10, 50, 100, 200, 500, 1000)
RERANK, RECALL = "the of and", 0.97
WORDS = "the of de and to in la a der is that en it for was on die with que le be as des und by".split()
PAIRS = [f"{a} {WORDS[(i + k) % len(WORDS)]}" for k in (3, 8) for i, a in enumerate(WORDS)]
SYNTAX = ['"of the"', "that OR und -de", "whi* the", 'and -"to the"']


class knowledge(dict):
    """The knowledge tables by name, each made when it is asked for: citations are found by jobs of their own."""

    def __init__(self, spark: SparkSession, d: str):
        super().__init__()
        self._from = spark, d

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(K, name)(*self._from)
        return self[name]


def query_vector(spark: SparkSession, d: str) -> DataFrame:
    return K.read(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("query"))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- search -----------------------------------------------------------------

def lexical_blocks(s, d):
    return search.lexical_blocks(K.blocks(s, d), QUERY, LIMIT)


def title_match(s, d):
    return search.title_match(K.documents(s, d), WORD, LIMIT)


def _text_index(s, d):
    return fulltext.write(fulltext.build(K.blocks(s, d), "block_id", "text"), folder(s, "text-index"))


def lexical_blocks_indexed(s, d):
    return search.lexical_blocks(K.blocks(s, d), QUERY, LIMIT, _text_index(s, d))


def title_match_indexed(s, d):
    docs = K.documents(s, d)
    index = fulltext.write(fulltext.build(docs, "doc_id", "title"), folder(s, "title-index"))
    return search.title_match(docs, WORD, LIMIT, index)


def fulltext_pairs(s, d):
    """Fifty queries of two words in one pass."""
    return fulltext.search(_text_index(s, d), PAIRS, LIMIT)[0]


def fulltext_syntax(s, d):
    """A phrase, alternatives, exclusions and a prefix."""
    return fulltext.search(_text_index(s, d), SYNTAX, LIMIT)[0]


def fulltext_skipped(s, d):
    """How many ranges of blocks each query could have needed, and how many it read."""
    return fulltext.search(_text_index(s, d), PAIRS, LIMIT)[1].select("query", "ranges", "read")


def entity_ilike(s, d):
    return search.entity_match(K.entities(s, d), "brand#1", LIMIT)


def knn_exact(s, d):
    return search.nearest(K.blocks(s, d), query_vector(s, d), LIMIT)


def _vector_index(s, d):
    v = spread(K.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return v, neighbours.build(v, folder(s, "vector-index"), 64)


def _vector_queries(v):
    """Every twentieth vector: a stated set, asked against all rows."""
    return neighbours.usable(v, 64).filter("id % 20 = 0")


def knn_indexed(s, d):
    """The nearest of every twentieth vector by the index, with as many probes as a recall of RECALL needs."""
    v, index = _vector_index(s, d)
    return neighbours.search(index, _vector_queries(v), LIMIT, neighbours.tune(index, LIMIT, RECALL)).select("query", "rank", "id", F.round("score", 6).alias("score"))


def knn_indexed_all(s, d):
    """The same with every cell probed: the rows of a scan."""
    v, index = _vector_index(s, d)
    return neighbours.search(index, _vector_queries(v), LIMIT, len(index.centroids)).select("query", "rank", "id", F.round("score", 6).alias("score"))


def knn_recall(s, d):
    """One row: the recall of ``knn_indexed`` against a scan, cells, probes, and the share of the bytes that a query reads."""
    v, index = _vector_index(s, d)
    asked, probes = _vector_queries(v), neighbours.tune(index, LIMIT, RECALL)
    share = neighbours.recall(neighbours.search(index, asked, LIMIT, probes), neighbours.exact(neighbours.usable(v, 64), asked, LIMIT))
    read = neighbours.read_share(index, asked, LIMIT, probes)
    return read.agg(F.count("*").alias("queries"), F.round(F.avg("bytes_share"), 4).alias("bytes_share")).select("queries", F.lit(len(index.centroids)).alias("cells"), F.lit(probes).alias("probes"), F.lit(round(share, 6)).alias("recall"), "bytes_share")


def vector_normalize(s, d):
    cut = K.read(s, d, "embeddings").select("vec_id", V.fit_dimension(F.col("embedding"), 48).alias("cut"))
    return cut.select("vec_id", F.size("cut").alias("n"), F.round(V.norm(F.col("cut")), 6).alias("length"), F.round(F.element_at("cut", 1), 6).alias("first"))


def rrf_fusion(s, d):
    b = K.blocks(s, d)
    return search.fuse([search.lexical_blocks(b, QUERY, LIMIT), search.nearest(b, query_vector(s, d), LIMIT)]).select("id", "result_type", "path", "score")


def graph_weights(s, d):
    t = knowledge(s, d)
    return search.graph_weights(t["documents"], t["references"], t["citations"])


def hybrid_search(s, d):
    return search.hybrid_search(knowledge(s, d), QUERY, query_vector(s, d), LIMIT)


def hybrid_search_plain(s, d):
    return search.hybrid_search(knowledge(s, d), QUERY, None, LIMIT, min_score=0.01, rerank=False)


def search_tag_filter(s, d):
    docs = K.documents(s, d)
    return search.with_tags(search.lexical_blocks(K.blocks(s, d), QUERY, LIMIT), docs, ["EN", "src1"]).select("id", "path", "score")


def heuristic_rerank(s, d):
    found = search.lexical_blocks(K.blocks(s, d), QUERY, LIMIT)
    hits = found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over a result list
    return search.rerank(hits, RERANK, head=10).select("id", "position", "score")


def rules_clamp(s, d):
    v = (F.col("p_retailprice") - 900) / 10
    rules = {**search.RULES, **search.COMPILE_RULES}
    return K.read(s, d, "part").select("p_partkey", *[search.clamp_rule(v, r).alias(n) for n, r in rules.items()])


CHANNELS = """,
lex as (
  select concat('block:', block_id) as id, 'block' as result_type, path, title, 1 as page_no, cast(len(list_filter(tk, lambda x: x = 'the')) + len(list_filter(tk, lambda x: x = 'that')) as double) as score, left(text, 300) as snippet
  from (select *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as tk from kb_blocks) t
  where list_contains(tk, 'the') and list_contains(tk, 'that') order by score desc, id limit 20),
q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0),
sem as (
  select concat('block:', block_id) as id, 'semantic_block' as result_type, path, title, 1 as page_no, round(list_cosine_similarity(cast(embedding as double[]), v), 6) as score, left(text, 300) as snippet
  from kb_blocks, q where embedding is not null order by score desc, id limit 20)"""
TITLES = """,
ttl as (
  select concat('document:', doc_id) as id, 'document' as result_type, path, title, cast(null as integer) as page_no, score, left(content_md, 300) as snippet
  from (select *, cast({score} as double) as score from (select *, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') as tk from kb_documents) t0
    where not archived and kind in ('wiki', 'system')) t
  where {match} order by score desc, id limit 20)"""
ENTITIES = """,
ent as (
  select concat('entity:', entity_id) as id, 'entity' as result_type, concat('/wiki/entities/', coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item'), '.md') as path, title, cast(null as integer) as page_no, 1.0::double as score, left(summary, 300) as snippet
  from kb_entities where title ilike '{p}' or summary ilike '{p}' order by entity_id desc limit 20)"""
BOTH = dict(score="len(list_filter(tk, lambda x: x = 'the')) + len(list_filter(tk, lambda x: x = 'that'))", match="list_contains(tk, 'the') and list_contains(tk, 'that')")
ONE = dict(score="len(list_filter(tk, lambda x: x = 'the'))", match="list_contains(tk, 'the')")
WEIGHTS = """,
wgt as (
  select doc_id, path, (select count(*) from kb_references r where r.target_document_id = d.doc_id) + (select count(*) from kb_citations c where c.source_document_id = d.doc_id) as weight
  from kb_documents d where not archived)"""


def _hybrid_sql(channels: list[str], min_score: float, rerank: bool) -> str:
    union = " union all ".join(f"select *, {i} as channel from {c}" for i, c in enumerate(channels))
    last = """
select f.* exclude (k1, k2), cast(f.k1 as int) as position from ("""
    body = f"""{CHANNELS}{TITLES.format(**BOTH)}{ENTITIES.format(p='%the that%')}{WEIGHTS},
rk as (select *, row_number() over (partition by channel order by score desc, id) as rnk from ({union}) u),
fu as (
  select id, arg_max(struct_pack(result_type, path, title, page_no, snippet), row(coalesce(score, 0), -channel)) as b, round(sum(1.0::double / (60 + rnk)), 6) as fused, min(row(channel, rnk)) as first
  from rk group by id),
bo as (
  select id, b.result_type as result_type, b.path as path, b.title as title, b.page_no as page_no, b.snippet as snippet, first,
    round(fused + coalesce(weight, 0) / (select greatest(1, max(weight)) from wgt) * 0.15::double, 6) as score
  from fu left join wgt on wgt.path = b.path),
cu as (select *, row_number() over (order by score desc, first, id) as pos from bo where score >= {min_score} order by score desc, first, id limit 20)"""
    if not rerank:
        return K.with_views(f"{body}\nselect id, result_type, path, title, page_no, snippet, score, cast(pos as int) as position from cu")
    cover = "round(len(list_intersect(['the', 'that'], regexp_extract_all(lower(coalesce(nullif(snippet, ''), title, '')), '[\\p{L}\\p{N}_]+'))) / 2.0::double, 6)"
    return K.with_views(f"{body}\nselect id, result_type, path, title, page_no, snippet, score, cast(row_number() over (order by score desc, pos) as int) as position from (select * exclude (score), {cover} as score from cu) x")


# --- text and compile -------------------------------------------------------

def split_blocks(s, d):
    b = compiling.split_blocks(K.conversation_markdown(s, d))
    return b.select("doc_id", "chunk_idx", "block_type", F.array_join("heading_path", " > ").alias("heading_path"), "content_hash", "token_count")


def block_hash_diff(s, d):
    c = K.read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), "text")
    ends = c.groupBy("doc_id").agg(F.min("chunk_idx").alias("lo"), F.max("chunk_idx").alias("hi"))
    old = c.withColumn("content_hash", F.sha2("text", 256))
    new = c.join(ends, "doc_id").filter("chunk_idx < hi").withColumn("content_hash", F.sha2(F.when(F.col("chunk_idx") == F.col("lo"), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")), 256))
    return compiling.block_actions(old, new)


def extract_sections(s, d):
    return compiling.sections(K.conversation_markdown(s, d), ["Assistant"]).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def table_render(s, d):
    return compiling.render_table(K.read(s, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"], ["n_nationkey"])


def replace_once(s, d):
    t = K.documents(s, d)
    new = T.replace_once(F.col("content_md"), F.lit("that"), F.lit("THAT"))
    return t.select("doc_id", T.occurrences(F.col("content_md"), F.lit("that")).alias("n"), F.sha2(new, 256).alias("hash"))


def append_md(s, d):
    t = K.read(s, d, "conversations")
    return t.select("conv_id", "turn", F.sha2(T.append_markdown(F.concat("text", F.lit(" \n")), F.concat(F.lit("\n "), "role")), 256).alias("hash"))


def page_range(s, d):
    spec = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit(","), (F.col("p_size") + 1).cast("string"), F.lit(","), (F.col("p_partkey") % 7).cast("string"))
    return K.read(s, d, "part").select("p_partkey", F.array_join(T.page_range(spec), ",").alias("pages"))


def slugify(s, d):
    return K.documents(s, d).select("doc_id", T.slugify(F.col("title")).alias("slug"))


def unique_slugs(s, d):
    return compiling.unique_slugs(K.entities(s, d).select("entity_id", "title"), "title", "entity_id").select("entity_id", "slug")


def pct_format(s, d):
    return K.claims(s, d).select("claim_id", T.percent(F.col("confidence")).alias("pct"))


def token_counts(s, d):
    return K.documents(s, d).select("doc_id", T.token_count(F.col("content_md")).alias("words"), F.size(T.lines(F.col("content_md"))).alias("lines"), F.sha2("content_md", 256).alias("hash"))


def html_to_text(s, d):
    return K.read(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def entity_upsert_fold(s, d):
    return compiling.upsert_entities(K.entities(s, d), "entity_id")


def relation_provenance(s, d):
    return compiling.relation_summary(compiling.provenance(K.relations(s, d)))


def relation_cleanup(s, d):
    gone = K.documents(s, d).filter("kind = 'source'").select(F.col("doc_id").alias("source_document_id"))
    return compiling.relation_summary(compiling.without_documents(K.relations(s, d), gone))


def claims_threshold(s, d):
    return compiling.accept_claims(K.claims(s, d), 0.5).select("claim_id", "entity_id", "confidence")


def quote_match(s, d):
    lines = K.documents(s, d).select("doc_id", F.posexplode(F.split("content_md", "\n")).alias("chunk_idx", "text"))
    cited = K.citations(s, d).select("claim_id", F.col("source_document_id").alias("doc_id"), F.col("quote_text").alias("quote"))
    return compiling.match_quotes(cited, lines)


def citation_purge(s, d):
    gone = K.documents(s, d).filter("policy = 'locked'").select(F.col("doc_id").alias("source_document_id"))
    return compiling.purge(K.claims(s, d), K.citations(s, d), gone).select("claim_id", "entity_id")


def page_markdown(s, d):
    t = knowledge(s, d)
    return compiling.pages(t["entities"], t["claims"], t["relations"], "benchmark")


# --- documents --------------------------------------------------------------

def doc_list_prefix(s, d):
    return documents.with_prefix(K.documents(s, d), "/wiki/src1", "wiki").select("path", "title")


def doc_glob(s, d):
    return documents.matching(K.documents(s, d), "wiki/src1?/*.md").select("path")


def doc_by_path(s, d):
    return K.documents(s, d).filter(F.col("path").endswith("/doc-7.md")).select("doc_id", "path", "kind", "policy")


def doc_head(s, d):
    return documents.heads(K.revisions(s, d))


def prev_revision(s, d):
    return documents.with_previous(K.revisions(s, d)).select("revision_id", "previous_id")


def revision_feed(s, d):
    return documents.latest(K.revisions(s, d), "created_at", "revision_id")


def activity_feed(s, d):
    e = documents.latest(K.read(s, d, "events").select("event_id", F.col("user_id").alias("doc_id"), "ts", "event_type"), "ts", "event_id")
    return e.join(K.documents(s, d).select("doc_id", "path"), "doc_id", "left")


def run_feed(s, d):
    return documents.latest(K.runs(s, d).filter("status <> 'running'"), "ts", "seq")


def _consecutive(s, d):
    c = K.read(s, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("created_at"), F.col("turn").alias("revision_id"), F.col("text").alias("content_md"))
    return documents.with_previous(c)


def diff_stats(s, d):
    r = _consecutive(s, d)
    return r.select("document_id", "revision_id", *[c.alias(n) for n, c in documents.distinct_line_stats(F.col("previous_md"), F.col("content_md")).items()])


def diff_lines(s, d):
    r = _consecutive(s, d).select("document_id", "revision_id", documents.line_diff("previous_md", "content_md").alias("diff"))
    return r.select("document_id", "revision_id", F.posexplode("diff").alias("pos", "x")).select("document_id", "revision_id", "pos", "x.type", "x.text")


def lint_findings(s, d):
    return documents.lint(K.documents(s, d))


def workspace_counts(s, d):
    return documents.counts(K.documents(s, d))


def tenant_scope(s, d):
    docs = K.documents(s, d)
    return documents.in_workspace(K.references(s, d).withColumnRenamed("source_document_id", "doc_id"), "en", docs).select("doc_id", "target_document_id")


def token_validity(s, d):
    e = K.read(s, d, "events")
    t = e.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("interval 30 days")).alias("expires_at"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked_at"))
    return documents.valid_tokens(t, "2024-01-20 00:00:00").select("event_id")


def policy_guard(s, d):
    docs = K.documents(s, d).select("doc_id", "policy", "path")
    ops = documents.policy_table(s).select("surface", "operation").distinct()
    return documents.guarded(docs.join(F.broadcast(ops))).select("doc_id", "surface", "operation", "error")


def export_pages(s, d):
    return documents.export_pages(K.documents(s, d)).select("path", F.sha2("content_md", 256).alias("hash"))


# --- graph ------------------------------------------------------------------

def graph_nodes(s, d):
    return graph.workspace_graph(knowledge(s, d)).nodes


def graph_edges(s, d):
    return graph.workspace_graph(knowledge(s, d), 1000, 2000).edges


def graph_claims_only(s, d):
    return graph.workspace_graph(knowledge(s, d), 1000, 2000, include_documents=False).edges


def graph_documents_only(s, d):
    return graph.workspace_graph(knowledge(s, d), 1000, 2000, include_claims=False).nodes


def graph_summary(s, d):
    return graph.workspace_graph(knowledge(s, d)).summary


def _focus_graph(s, d):
    """Around the cited document of smallest id."""
    t = knowledge(s, d)
    t["citations"] = stored(t["citations"], "citations")
    return graph.focus_graph(t, t["citations"].agg(F.min("source_document_id").alias("doc_id")))


def graph_focus_nodes(s, d):
    return _focus_graph(s, d).nodes


def graph_focus_edges(s, d):
    return _focus_graph(s, d).edges


def doc_references(s, d):
    return graph.neighbours(K.documents(s, d), K.references(s, d))


def doc_citations(s, d):
    return graph.document_citations(K.citations(s, d), K.claims(s, d), K.documents(s, d))


_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
_EPATH = f"concat('/wiki/', case when entity_type in ('person','company','organization','project','product','protocol','event') then 'entities' else 'concepts' end, '/', {_SLUG.format('title')}, '.md')"


def _graph_sql(focus: bool, nodes: int, edges: int, out: str, claims: bool = True, documents: bool = True) -> str:
    f = "(select min(source_document_id) from kb_citations)"
    cit = f"kb_citations where source_document_id = {f}" if focus else "kb_citations"
    clm = "kb_claims where claim_id in (select claim_id from cit)" if focus else "kb_claims"
    ent = "kb_entities where entity_id in (select entity_id from clm)" if focus else "kb_entities"
    rel = "kb_relations where source_entity_id in (select entity_id from clm)" if focus else "kb_relations"
    ref = f"kb_references where source_document_id = {f} or target_document_id = {f}" if focus else "kb_references"
    return K.with_views(f""",
cit as (select * from {cit}{"" if claims and documents else " where false"}), clm as (select * from {clm}{"" if claims else " where false"}), rel as (select distinct source_entity_id, target_entity_id, relation_type from {rel}), ref as (select distinct * from {ref}{"" if documents else " where false"}),
nod as (
  select concat('entity:', entity_id) as id, 'entity' as type, entity_id as ref_id, title as label, entity_type as subtype, {_EPATH} as path, 0 as st from (select * from {ent}) e
  union all select concat('claim:', claim_id), 'claim', claim_id, case when length(canonical_text) > 120 then concat(left(canonical_text, 120), '…') else canonical_text end, null, null, 1 from clm
  union all select concat('document:', doc_id), 'document', doc_id, title, kind, path, {f"case when doc_id = {f} then -1 else 2 end" if focus else 2} from kb_documents
    where {f"doc_id = {f} or " if focus else ""}doc_id in (select source_document_id from cit union select source_document_id from ref union select target_document_id from ref)),
edg as (
  select concat_ws('|', type, source, target, label) as id, * from (
    select 'relation' as type, concat('entity:', source_entity_id) as source, concat('entity:', target_entity_id) as target, relation_type as label, 0 as st from rel
    union all select 'claim_entity', concat('claim:', claim_id), concat('entity:', entity_id), 'supports', 1 from clm
    union all select 'citation', concat('claim:', claim_id), concat('document:', source_document_id), 'cites', 2 from cit
    union all select 'reference', concat('document:', source_document_id), concat('document:', target_document_id), ref_type, 3 from ref) x
  where source in (select id from nod) and target in (select id from nod)),
shown as (select * exclude (st) from nod order by st, ref_id limit {nodes}),
kept as (select id, type, source, target, label from (select * from edg order by st, id limit {edges}) x where source in (select id from shown) and target in (select id from shown))
{out}""")


_SUMMARY = "select * from (select " + ", ".join(f"count(*) filter (type = '{k}') as {k}_nodes" for k in ("entity", "claim", "document")) + " from shown) a, (select " + ", ".join(f"count(*) filter (type = '{k}') as {k}_edges" for k in ("relation", "claim_entity", "citation", "reference")) + " from kept) b, (select (select count(*) from nod) >= 300 or (select count(*) from edg) >= 600 as truncated) c"


# --- queue and metrics ------------------------------------------------------

def enqueue_idempotent(s, d):
    return queueing.accepted(K.read(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")


def retry_state(s, d):
    return queueing.attempts(K.runs(s, d))


def dlq_route(s, d):
    return queueing.dead_letters(K.runs(s, d))


def dlq_replay(s, d):
    r = K.runs(s, d)
    return queueing.replay(r, queueing.dead_letters(r))


def run_status_final(s, d):
    return queueing.final_status(K.runs(s, d))


def metrics_histogram(s, d):
    return queueing.histogram(K.read(s, d, "events"), "event_type", "value", BUCKETS)


def p95_by_type(s, d):
    return queueing.bucket_quantile(K.read(s, d, "events"), "event_type", "value", BUCKETS, 0.95)


def event_rate(s, d):
    return queueing.rates(K.read(s, d, "events"), "ts", ["event_type"], 3600)


def event_rate_sliding(s, d):
    return queueing.sliding_rates(K.read(s, d, "events"), "ts", ["event_type"], 3600, 900)


def quantile_sliding(s, d):
    """The 95th percentile of every six hours, each hour, from sketches of each hour."""
    pieces = queueing.sketches(K.read(s, d, "events"), "ts", ["event_type"], "value", 3600)
    found = queueing.sliding_quantile(pieces, ["event_type"], 21600, 3600, 0.95)
    return found.select("event_type", "start", "n", F.round("quantile", 6).alias("quantile"))


def counter_increase(s, d):
    """Growth of a counter of each user; the event's value as its reading."""
    readings = K.read(s, d, "events").select("user_id", "ts", F.floor("value").alias("reading"))
    return queueing.increases(readings, "ts", ["user_id"], "reading", 86400, 43200)


def queue_depths(s, d):
    return queueing.depths(K.runs(s, d))


def reclaim_idle(s, d):
    return queueing.reclaim(K.runs(s, d), "2024-12-31 00:00:00")


def props_filter(s, d):
    return documents.with_member(K.read(s, d, "events"), "props", "k", "7").select("event_id")


def vault_filter(s, d):
    return documents.vault_search(K.documents(s, d).withColumn("status", F.lit("ready")), "SRC1").select("doc_id")


def search_limits(s, d):
    size = F.col("p_size") * 2 - 10
    return K.read(s, d, "part").select("p_partkey", search.api_limit(size, F.lit(15)).alias("api"), search.agent_limit(size, F.lit(15)).alias("agent"))


# --- extraction, reading, commands ------------------------------------------

def extraction_entities(s, d):
    """Every word of a document as a raw title; the first of each slug stays."""
    docs = spread(K.read(s, d, "documents").select("doc_id", F.col("source").alias("source_title"), "text"))
    kind, about = lambda i: F.when(i % 3 == 0, "product"), lambda i, w: F.when(i % 2 == 0, F.concat(F.lit("about "), w))
    raw = F.transform(F.split("text", "[ \n]"), lambda w, i: F.struct(i.alias("nth"), w.alias("title"), kind(i).alias("entity_type"), about(i, w).alias("summary")))
    return extracting.clean_entity_lists(docs.select("doc_id", "source_title", raw.alias("raw"))).select("doc_id", "slug", "nth", "title", "entity_type", "summary")


def extraction_claims(s, d):
    line = K.read(s, d, "lineitem")
    conf = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount") * 20 - 0.4)
    raw = line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("nth"), F.nullif("l_returnflag", F.lit("N")).alias("entity_title"), F.col("l_linestatus").alias("text"), conf.alias("confidence"), F.repeat("l_linestatus", F.lit(500)).alias("quote"))
    return extracting.clean_claims(raw, 0.5).select("doc_id", "nth", "entity_title", "text", F.round("confidence", 6).alias("confidence"), F.length("quote").alias("quote_length"))


def extraction_relations(s, d):
    line = K.read(s, d, "lineitem")
    raw = line.select((F.col("l_orderkey") % 1000).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"), F.replace("l_returnflag", F.lit("N"), F.lit("")).alias("source_title"), (F.col("l_suppkey") % 5).cast("string").alias("target_title"), F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("relation_type"))
    return extracting.clean_relations(raw).select("doc_id", "nth", "source_title", "target_title", "relation_type")


def default_extraction(s, d):
    """Claims that the extractor finds in all documents without a model."""
    docs = spread(K.read(s, d, "documents").select("doc_id", "text", "source"))
    return extracting.extract_clean(docs.select("doc_id", F.lit(0).alias("chunk_idx"), "text"), docs.select("doc_id", F.col("source").alias("title")))[1]


def _globs(s, d):
    """A pattern for each supplier and some for all."""
    i = F.col("s_suppkey")
    one = K.pick(i % 4, "wiki/source/doc-%d*", "/wiki/*/doc-%d.md", "/sources/source/doc-?%d.md", "*-%d?.md")
    return K.read(s, d, "supplier").select(i.alias("pattern_id"), F.replace(one, F.lit("%d"), i.cast("string")).alias("pattern"))


def pattern_list(s, d):
    return reading.listed(K.documents(s, d).withColumn("status", F.lit("ready")), _globs(s, d)).select("pattern_id", "position", "line")


def read_requests(s, d):
    """A read of each conversation, by turn as page, by section, or whole, and of a pattern."""
    docs = K.conversation_markdown(s, d).withColumns({"path": F.concat(F.lit("/wiki/c-"), F.col("doc_id").cast("string"), F.lit(".md")), "kind": F.lit("wiki"), "archived": F.lit(False)})
    pages = _turns(s, d).select("doc_id", F.col("chunk_idx").alias("page_no"), "text")
    n = F.col("doc_id")
    asked = docs.select(n.alias("request_id"), F.when(n % 5 == 4, F.concat(F.lit("wiki/c-"), n.cast("string"), F.lit("?.md"))).otherwise(F.col("path")).alias("path"), F.when(n % 5 == 1, "1, 0-2").when(n % 5 == 2, "99").alias("pages"), F.when(n % 5 == 3, F.array(F.lit("Assistant"))).alias("sections"))
    return reading.read(docs, pages, asked).select("request_id", F.sha2("text", 256).alias("hash"))


def text_budget(s, d):
    turns = _turns(s, d).select("doc_id", F.col("chunk_idx").alias("nth"), "text")
    return reading.budgeted(turns, 700).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def _commands(s, d):
    """Agents append to every wiki page and archive every third; a page is made for each nation, twice."""
    pages, n = K.documents(s, d).filter("kind = 'wiki' and not archived"), F.col("doc_id")
    no = F.lit(None).cast("string")
    rest = lambda op, new: [F.lit("agent").alias("surface"), F.lit(op).alias("operation"), no.alias("title"), no.alias("kind"), no.alias("policy"), no.alias("old_text"), new.alias("new_text")]
    adds = pages.select((n * 2).alias("seq"), "path", *rest("append", F.lit("a note")))
    gone = pages.filter(n % 3 == 0).select((n * 2 + 1).alias("seq"), "path", *rest("delete", no))
    made = K.read(s, d, "nation").select((-F.col("n_nationkey") * 2 - 2).alias("seq"), F.concat(F.lit("wiki/n/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), *rest("create", F.col("n_name")))
    return adds.unionByName(gone).unionByName(made).unionByName(made.withColumn("seq", F.col("seq") + 1))


def command_steps(s, d):
    return journal.run_commands(K.documents(s, d), _commands(s, d), AS_OF)["steps"].select("seq", "path", "step_key", "status", "error")


def command_documents(s, d):
    return journal.run_commands(K.documents(s, d), _commands(s, d), AS_OF)["documents"].select("path", "kind", "policy", "archived", "status", "head", F.sha2("content_md", 256).alias("hash"))


def head_pointers(s, d):
    """Documents through the pointer to their head, after a commit of all tables."""
    log = journal.Journal(s, folder(s, "journal"))
    log.commit(journal.run_commands(K.documents(s, d), _commands(s, d), AS_OF, keep=True))
    return journal.with_heads(log.documents(), log.read("revisions")).select("path", "head", F.sha2("head_md", 256).alias("hash"))


# --- writing ----------------------------------------------------------------

def _turns(s, d):
    return K.read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), "text")


def block_upsert(s, d):
    old = _turns(s, d).withColumn("content_hash", F.sha2("text", 256))
    fresh = _turns(s, d).filter("doc_id % 3 = 0 and chunk_idx < 3")
    fresh = fresh.withColumn("text", F.when(F.col("chunk_idx") == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    # every sixth conversation is ingested too, and now has no blocks
    fresh = fresh.filter("doc_id % 6 <> 3")
    return writing.apply_blocks(old, fresh, old.filter("doc_id % 3 = 0")).select("doc_id", "chunk_idx", "content_hash", "written")


def page_replace(s, d):
    old = _turns(s, d).select("doc_id", F.col("chunk_idx").alias("page_no"), "text")
    fresh = old.filter("doc_id % 8 = 1 and page_no = 0").withColumn("text", F.concat("text", F.lit(" again")))
    return writing.replace_pages(old, fresh, old.filter("doc_id % 4 = 1")).select("doc_id", "page_no", F.sha2("text", 256).alias("hash"))


def page_listing(s, d):
    pages = _turns(s, d).select("doc_id", F.col("chunk_idx").alias("page_no"), "text")
    return documents.listing(pages, "page_no", F.col("doc_id") % 5 == 2).select("doc_id", "position", "page_no", "char_count")


def pages_read(s, d):
    pages = _turns(s, d).select("doc_id", F.col("chunk_idx").alias("page_no"), "text")
    return documents.read_pages(pages, "1-2, 4").select("doc_id", F.sha2("text", 256).alias("hash"))


def reference_upsert(s, d):
    rows = K.references(s, d).withColumns({"seq": F.lit(0), "metadata": F.lit("first")})
    again = rows.filter("source_document_id % 2 = 0").withColumns({"seq": F.lit(1), "metadata": F.lit("second")})
    return writing.upsert_references(rows.unionByName(again), "seq").select("source_document_id", "target_document_id", "ref_type", "metadata")


def run_updates(s, d):
    e = K.read(s, d, "events")
    kind, started, done = F.col("event_type"), F.col("event_type") == "signup", F.col("event_type") == "purchase"
    status = F.when(kind == "error", "failed").when(done, "succeeded").when(started, "running")
    changes = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.when(done, F.col("props")).alias("output"), F.when(kind == "error", F.col("props")).alias("error_message"), started.alias("started_now"), done.alias("completed_now"))
    return writing.update_runs(changes, "run_id", "ts", "seq")


def _actions(s, d):
    pages = K.documents(s, d).filter("kind = 'wiki' and not archived")
    n = F.col("doc_id")
    first = pages.filter(n % 5 == 1).select((n * 2).alias("seq"), "path", "title", F.when(n % 2 == 0, "append_content").otherwise("replace_section").alias("op"), F.concat(F.lit("# "), "title").alias("content"))
    then = pages.filter(n % 10 == 1).select((n * 2 + 1).alias("seq"), "path", "title", F.lit("append_content").alias("op"), F.lit("a later note").alias("content"))
    new = K.read(s, d, "nation").select((-F.col("n_nationkey") - 1).alias("seq"), F.concat(F.lit("/wiki/new/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".md")).alias("path"), F.col("n_name").alias("title"), F.lit("append_content").alias("op"), F.concat(F.lit("About "), "n_name").alias("content"))
    return first.unionByName(then).unionByName(new).withColumn("reason", F.lit("ingest"))


def wiki_writes(s, d):
    revisions, pieces = writing.page_pieces(K.documents(s, d), _actions(s, d))
    return writing.revision_texts(revisions, pieces).select("path", "seq", "op", "created", F.sha2("content_md", 256).alias("hash"))


def wiki_heads(s, d):
    docs = writing.apply_actions(K.documents(s, d), _actions(s, d))[0]
    return docs.select("path", "kind", "policy", F.sha2("content_md", 256).alias("hash"))


def overview_refresh(s, d):
    """After the ingest of each workspace's last source."""
    docs = K.documents(s, d)
    last = F.max_by("title", "doc_id").alias("title")
    updates = docs.filter("kind = 'source' and not archived").groupBy("workspace_id").agg(last, F.count("*").alias("nodes"), F.min("doc_id").alias("pages"))
    return writing.overview(docs, updates)


def claim_citations(s, d):
    lines = K.documents(s, d).select("doc_id", F.posexplode(F.split("content_md", "\n")).alias("chunk_idx", "text"))
    cited = K.citations(s, d).select("claim_id", F.col("source_document_id").alias("doc_id"), F.when(F.col("claim_id") % 2 == 0, F.col("quote_text")).alias("quote"))
    return compiling.cite_claims(cited, lines).select("claim_id", "doc_id", "chunk_idx", F.sha2("quote_text", 256).alias("hash"), "precision")


def paragraph_match(s, d):
    t = _turns(s, d)
    return compiling.match_paragraphs(t, t.filter("chunk_idx % 2 = 0").select("doc_id", F.col("chunk_idx").alias("para_no"), "text"))


def _events(s, d, *columns):
    schema = K.read(s, d, "events").schema
    return queue.messages(s, f"{d}/event*.parquet", schema)


def stream_routes(s, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "succeeded").otherwise("running")
    runs = _events(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    return queue.drain(queue.routes(runs), "routes")


def stream_first_seen(s, d):
    kept = queue.first_seen(_events(s, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")
    return queue.drain(kept.select("user_id", "event_type"), "first-seen")


def stream_run_lives(s, d):
    """Transitions, retries, reclaims and refused rows of all runs, by keyed state with event-time timers."""
    s.conf.set(*lives.PROVIDER)
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "succeeded").when(kind == "signup", "queued").otherwise("running")
    messages = _events(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    return queue.drain(lives.lives(messages), "run-lives")


_FAILED = ", f as (select *, row_number() over (partition by run_id order by ts, seq) as attempt from kb_runs where status = 'failed')"
_RULES = ", ".join(f"greatest({float(a)}::double, least({float(b)}::double, v)) as {n}" for n, (_, a, b) in {**search.RULES, **search.COMPILE_RULES}.items())
_LINES = "case when {0} is null or {0} = '' then [] when ends_with({0}, chr(10)) then string_split({0}, chr(10))[:-2] else string_split({0}, chr(10)) end"
_BLOCKS = """,
ln as (select doc_id, unnest(string_split(content_md, chr(10))) as line, generate_subscripts(string_split(content_md, chr(10)), 1) as pos from kb_markdown),
fl as (select *, starts_with(line, '#') as heading, trim(line) = '' as blank from ln),
pt as (select *, sum(cast(heading or blank as int)) over w as part, sum(cast(heading as int)) over w as nth from fl window w as (partition by doc_id order by pos)),
bl as (select doc_id, part, nth, heading, min(pos) as pos, trim(string_agg(line, chr(10) order by pos)) as raw from pt where heading or not blank group by all),
hd as (select *, case when heading then trim(regexp_replace(raw, '^#+', '')) else raw end as text, case when heading then length(regexp_extract(raw, '^#+')) end as level from bl),
pa as (
  select *, last_value(case when level = 1 then text end ignore nulls) over w as h1, last_value(case when level = 2 then text end ignore nulls) over w as h2,
    last_value(level ignore nulls) over w as lv
  from hd window w as (partition by doc_id order by pos))
"""
_POLICY = "case " + " ".join(f"when surface = '{a}' and operation = '{o}' and policy in ({', '.join(repr(p) for p in ok)}) then null" for (a, o), ok in documents.ALLOWED.items()) + " else 'policy' end"
_OPS = ", ".join(f"('{a}', '{o}')" for a, o in documents.ALLOWED)
_REL = "select source_entity_id, target_entity_id, relation_type, count(distinct source_document_id) as documents, min(source_document_id) as first_document, max(source_document_id) as last_document from kb_relations {0} group by all"

_WRITES = """,
p as (select *, concat('# ', title) as c from kb_documents where kind = 'wiki' and not archived and doc_id % 5 = 1),
o as (select *, case when doc_id % 2 = 0 then 'append_content' else 'replace_section' end as op from p),
q as (select *, case when op = 'replace_section' then c when trim(coalesce(content_md, ''), ' ' || chr(10)) = '' then trim(c, ' ' || chr(10)) else concat(rtrim(content_md, ' ' || chr(10)), chr(10), chr(10), trim(c, ' ' || chr(10))) end as one from o),
w as (select *, case when trim(one, ' ' || chr(10)) = '' then 'a later note' else concat(rtrim(one, ' ' || chr(10)), chr(10), chr(10), 'a later note') end as two from q),
n as (select concat('/wiki/new/', lower(replace(n_name, ' ', '-')), '.md') as path, -n_nationkey - 1 as seq, n_name as title from nation)
"""

_TOKENS = ", t as (select block_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as tk from kb_blocks)"
_RANKED = " select query, cast(rnk as int) as rank, id, score from (select *, row_number() over (partition by query order by score desc, id) as rnk from u) x where rnk <= 20"

_COMMANDS = """,
p as (select *, policy in ('agent_editable', 'append_only') as may, concat(case when trim(coalesce(content_md, ''), ' ' || chr(10)) = '' then '' else concat(rtrim(content_md, ' ' || chr(10)), chr(10), chr(10)) end, 'a note') as noted from kb_documents where kind = 'wiki' and not archived),
n as (select concat('/wiki/n/', n_nationkey, '.md') as path, -n_nationkey * 2 - 2 as seq, n_name from nation),
e as (
  select path, kind, policy, may and doc_id % 3 = 0 as archived, doc_id * 2 + case when doc_id % 3 = 0 then 1 else 0 end as head, noted as content_md from p where may
  union all select path, 'wiki', 'agent_editable', false, seq, n_name from n)
"""

ENTRIES = [
    (lexical_blocks, K.with_views(CHANNELS + "\nselect * from lex")),
    (title_match, K.with_views(TITLES.format(**ONE) + "\nselect * from ttl")),
    (lexical_blocks_indexed, K.with_views(CHANNELS + "\nselect * from lex")),
    (title_match_indexed, K.with_views(TITLES.format(**ONE) + "\nselect * from ttl")),
    (fulltext_pairs, K.with_views(_TOKENS + ", p(query, a, b) as (values " + ", ".join("('{0}', '{1}', '{2}')".format(q, *q.split()) for q in PAIRS) + """),
u as (select query, id, cast(len(list_filter(tk, lambda x: x = a)) + case when a <> b then len(list_filter(tk, lambda x: x = b)) else 0 end as double) as score from t, p where list_contains(tk, a) and list_contains(tk, b))""" + _RANKED)),
    (fulltext_syntax, K.with_views(_TOKENS + """,
c as (
  select id, len(list_filter(generate_series(1, len(tk) - 1), lambda i: tk[i] = 'of' and tk[i + 1] = 'the')) as of_the, len(list_filter(generate_series(1, len(tk) - 1), lambda i: tk[i] = 'to' and tk[i + 1] = 'the')) as to_the,
    len(list_filter(tk, lambda x: x = 'that')) as that, len(list_filter(tk, lambda x: x = 'und')) as und, len(list_filter(tk, lambda x: x = 'de')) as de, len(list_filter(tk, lambda x: x = 'the')) as the, len(list_filter(tk, lambda x: x = 'and')) as n_and, len(list_filter(tk, lambda x: starts_with(x, 'whi'))) as whi from t),
u as (
  select '"of the"' as query, id, cast(of_the as double) as score from c where of_the > 0
  union all select 'that OR und -de', id, that + und from c where that > 0 or (und > 0 and de = 0)
  union all select 'whi* the', id, whi + the from c where whi > 0 and the > 0
  union all select 'and -"to the"', id, n_and from c where n_and > 0 and to_the = 0)""" + _RANKED)),
    (fulltext_skipped, None),
    (entity_ilike, K.with_views(ENTITIES.format(p="%brand#1%") + "\nselect * from ent")),
    (knn_exact, K.with_views(CHANNELS + "\nselect * from sem")),
    (knn_indexed, None),
    (knn_indexed_all, "with v as (select vec_id as id, cast(embedding as double[]) as v from embeddings where embedding is not null), h as (select a.id as query, b.id, list_cosine_similarity(a.v, b.v) as score from v a, v b where a.id % 20 = 0), r as (select *, row_number() over (partition by query order by score desc, id) as rank from h) select query, cast(rank as int) as rank, id, round(score, 6) as score from r where rank <= 20"),
    (knn_recall, None),
    (vector_normalize, "with c as (select vec_id, cast(embedding[1:48] as double[]) as c from embeddings), n as (select *, sqrt(list_inner_product(c, c)) as l from c) select vec_id, len(c) as n, 1.0::double as length, round(c[1] / l, 6) as first from n"),
    (rrf_fusion, K.with_views(CHANNELS + ", u as (select *, 0 as channel, row_number() over (order by score desc, id) as rnk from lex union all select *, 1, row_number() over (order by score desc, id) from sem) select id, arg_max(result_type, row(score, -channel)) as result_type, arg_max(path, row(score, -channel)) as path, round(sum(1.0::double / (60 + rnk)), 6) as score from u group by id")),
    (graph_weights, K.with_views(WEIGHTS + "\nselect * from wgt")),
    (hybrid_search, _hybrid_sql(["lex", "sem", "ttl", "ent"], 0.0, True)),
    (hybrid_search_plain, _hybrid_sql(["lex", "ttl", "ent"], 0.01, False)),
    (search_tag_filter, K.with_views(CHANNELS + "\nselect id, path, score from lex where path in (select path from kb_documents where list_has_any(list_transform(tags, lambda x: lower(x)), ['en', 'src1']))")),
    (heuristic_rerank, K.with_views(CHANNELS + """,
p as (select id, score, row_number() over (order by score desc, id) as pos, round(len(list_intersect(['the', 'of', 'and'], regexp_extract_all(lower(coalesce(nullif(snippet, ''), title, '')), '[\\p{L}\\p{N}_]+'))) / 3.0::double, 6) as cover from lex)
select id, cast(row_number() over (order by pos > 10, case when pos <= 10 then -cover end, pos) as int) as position, case when pos <= 10 then cover else score end as score from p""")),
    (rules_clamp, f"select p_partkey, {_RULES} from (select *, (p_retailprice - 900) / 10 as v from part) x"),
    (split_blocks, K.with_views(_BLOCKS + "select doc_id, row_number() over (partition by doc_id order by pos) - 1 as chunk_idx, case when heading then 'heading' when contains(text, '|') and contains(text, '---') then 'table' else 'paragraph' end as block_type, case when lv = 1 then h1 else concat(h1, ' > ', h2) end as heading_path, sha256(text) as content_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as token_count from pa where heading or text <> ''")),
    (block_hash_diff, "with m as (select conv_id, min(turn) as lo, max(turn) as hi from conversations group by 1) select c.conv_id as doc_id, turn as chunk_idx, case when turn = hi then 'delete' when turn = lo then 'update' else 'unchanged' end as action from conversations c join m on m.conv_id = c.conv_id"),
    (extract_sections, K.with_views(_BLOCKS + ", se as (select doc_id, nth, trim(string_agg(line, chr(10) order by pos), chr(10) || ' #') as t, max(case when heading then trim(line, '# ') end) as title from pt group by all), ch as (select doc_id, nth, trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) as chunk from (select *, max(case when heading then trim(line, '# ') end) over (partition by doc_id, nth) as title from pt) x where lower(title) = 'assistant' group by all) select doc_id, length(string_agg(chunk, chr(10) || chr(10) order by nth)) as n_chars, sha256(string_agg(chunk, chr(10) || chr(10) order by nth)) as hash from ch group by doc_id")),
    (table_render, "select n_regionkey, concat('| n_nationkey | n_name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', n_nationkey, ' | ', n_name, ' |'), chr(10) order by n_nationkey)) as table_md from nation group by 1"),
    (replace_once, "with n as (select doc_id, text, (length(text) - length(replace(text, 'that', ''))) // 4 as n from documents) select doc_id, n, sha256(case when n = 1 then replace(text, 'that', 'THAT') else text end) as hash from n"),
    (append_md, "select conv_id, turn, sha256(case when trim(text, ' ' || chr(10)) = '' then role else concat(rtrim(text, ' ' || chr(10)), chr(10), chr(10), role) end) as hash from conversations"),
    (page_range, "select p_partkey, array_to_string(list_sort(list_distinct([p_size, p_size + 1, p_size + 2, p_partkey % 7])), ',') as pages from part"),
    (slugify, f"select doc_id, {_SLUG.format('left(text, 60)')} as slug from documents"),
    (unique_slugs, f"with b as (select p_partkey as entity_id, {_SLUG.format('p_name')} as b from part), n as (select *, row_number() over (partition by b order by entity_id) as n from b) select entity_id, case when n > 1 then concat(b, '-', n) else b end as slug from n"),
    (pct_format, K.with_views("select claim_id, concat(cast(round_even(confidence * 100, 0) as int), '%') as pct from kb_claims")),
    (token_counts, f"select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words, len({_LINES.format('text')}) as lines, sha256(text) as hash from documents"),
    (html_to_text, "select page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from pages"),
    (entity_upsert_fold, K.with_views(f", s as (select *, {_SLUG.format('title')} as slug from kb_entities) select slug, arg_max(title, row(length(title), entity_id)) as title, arg_max(entity_type, entity_id) as entity_type, arg_max(summary, row(length(summary), -entity_id)) as summary from s group by slug")),
    (relation_provenance, K.with_views(_REL.format(""))),
    (relation_cleanup, K.with_views(_REL.format("where source_document_id not in (select doc_id from kb_documents where kind = 'source')"))),
    (claims_threshold, K.with_views("select claim_id, entity_id, least(1, greatest(0, confidence)) as confidence from kb_claims where confidence >= 0.5")),
    (quote_match, K.with_views(", ln as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as chunk_idx from documents), m as (select claim_id, doc_id, chunk_idx, len(list_filter(list_filter(regexp_split_to_array(lower(quote_text), '\\s+'), lambda x: x <> '')[1:10], lambda x: contains(lower(t), x))) as overlap from kb_citations join ln on ln.doc_id = source_document_id) select claim_id, doc_id, arg_max(chunk_idx, row(overlap, -chunk_idx)) as chunk_idx, max(overlap) as overlap from m where overlap > 0 group by 1, 2")),
    (citation_purge, K.with_views("select claim_id, entity_id from kb_claims where claim_id not in (select claim_id from kb_citations where source_document_id in (select doc_id from kb_documents where policy = 'locked'))")),
    (page_markdown, K.with_views(f""",
ev as (select entity_id, string_agg(concat('- ', canonical_text, ' (confidence: ', cast(round_even(confidence * 100, 0) as int), '%)'), chr(10) order by claim_id) as evidence from kb_claims group by 1),
en as (select source_entity_id as entity_id, target_entity_id as other, relation_type from kb_relations union select target_entity_id, source_entity_id, relation_type from kb_relations),
dr as (select distinct en.entity_id, concat('  this -->|', relation_type, '| "', o.title, '"') as edge from en join kb_entities o on o.entity_id = en.other where en.entity_id in (select entity_id from kb_claims)),
di as (select entity_id, string_agg(edge, chr(10) order by edge) as edges from dr group by 1)
select e.entity_id, {_EPATH} as path, concat('# ', title, chr(10), chr(10), summary, chr(10), chr(10), '| Type | Source |', chr(10), '| --- | --- |', chr(10), '| ', entity_type, ' | benchmark |', chr(10), chr(10), '```mermaid', chr(10), 'graph LR', chr(10),
  coalesce(edges, '  this --> source'), chr(10), '```', chr(10), chr(10), '## Evidence', chr(10), chr(10), evidence) as content_md
from kb_entities e join ev on ev.entity_id = e.entity_id left join di on di.entity_id = e.entity_id""")),
    (doc_list_prefix, K.with_views("select path, title from kb_documents where path like '/wiki/src1%' and not archived and kind = 'wiki'")),
    (doc_glob, K.with_views("select path from kb_documents where path glob '/wiki/src1?/*.md' and not archived")),
    (doc_by_path, K.with_views("select doc_id, path, kind, policy from kb_documents where ends_with(path, '/doc-7.md')")),
    (doc_head, K.with_views("select document_id, created_at, revision_id, content_md from (select *, row_number() over (partition by document_id order by created_at desc, revision_id desc) as n from kb_revisions) x where n = 1")),
    (prev_revision, K.with_views("select revision_id, lag(revision_id) over (partition by document_id order by created_at, revision_id) as previous_id from kb_revisions")),
    (revision_feed, K.with_views("select * from kb_revisions order by created_at desc, revision_id desc limit 100")),
    (activity_feed, K.with_views("select event_id, user_id as doc_id, ts, event_type, path from (select * from events order by ts desc, event_id desc limit 100) e left join kb_documents d on d.doc_id = e.user_id")),
    (run_feed, K.with_views("select * from kb_runs where status <> 'running' order by ts desc, seq desc limit 100")),
    (diff_stats, f"with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations), l as (select conv_id, turn, {_LINES.format('before')} as a, {_LINES.format('text')} as b from p) select conv_id as document_id, turn as revision_id, len(list_filter(list_distinct(b), lambda x: not list_contains(a, x))) as added, len(list_filter(list_distinct(a), lambda x: not list_contains(b, x))) as removed, len(a) as before_lines, len(b) as after_lines from l"),
    (diff_lines, None),
    (lint_findings, K.with_views(", d as (select * from kb_documents where path like '/wiki%' and not archived) select 'missing_page' as rule, p as path from (values ('/wiki/overview.md'), ('/wiki/log.md')) v(p) where p not in (select path from d) union all select 'sparse', path from d where length(trim(content_md, ' ' || chr(10) || chr(9))) < 40 union all select 'no_visual', path from d where starts_with(path, '/wiki/') and not contains(content_md, '```mermaid') and not contains(content_md, '|')")),
    (workspace_counts, K.with_views("select workspace_id, count(*) filter (not archived and kind = 'source') as source_documents, count(*) filter (not archived and kind = 'wiki') as wiki_documents, count(*) filter (not archived and kind = 'system') as system_documents, count(*) filter (archived) as archived_documents from kb_documents group by 1")),
    (tenant_scope, K.with_views("select source_document_id as doc_id, target_document_id from kb_references where source_document_id in (select doc_id from kb_documents where workspace_id = 'en')")),
    (token_validity, "select event_id from events where (event_id % 3 = 0 or ts + interval 30 day > timestamp '2024-01-20 00:00:00') and event_id % 7 <> 0"),
    (policy_guard, K.with_views(f"select doc_id, surface, operation, {_POLICY} as error from kb_documents, (values {_OPS}) o(surface, operation)")),
    (export_pages, K.with_views("select path, sha256(content_md) as hash from kb_documents where not archived and kind in ('wiki', 'system')")),
    (graph_nodes, _graph_sql(False, 300, 600, "select * from shown")),
    (graph_edges, _graph_sql(False, 1000, 2000, "select * from kept")),
    (graph_claims_only, _graph_sql(False, 1000, 2000, "select * from kept", claims=True, documents=False)),
    (graph_documents_only, _graph_sql(False, 1000, 2000, "select * from shown", claims=False, documents=True)),
    (graph_summary, _graph_sql(False, 300, 600, _SUMMARY)),
    (graph_focus_nodes, _graph_sql(True, 300, 600, "select * from shown")),
    (graph_focus_edges, _graph_sql(True, 300, 600, "select * from kept")),
    (doc_references, K.with_views("select r.*, a.path as source_path, a.title as source_title, b.path as target_path, b.title as target_title from kb_references r join kb_documents a on a.doc_id = r.source_document_id join kb_documents b on b.doc_id = r.target_document_id")),
    (doc_citations, K.with_views("select c.source_document_id, c.claim_id, quote_text, canonical_text, confidence, path from kb_citations c left join kb_claims m on m.claim_id = c.claim_id join kb_documents d on d.doc_id = c.source_document_id")),
    (enqueue_idempotent, "with recursive r as (select user_id, event_type, min(ts) as ts from events group by 1, 2 union all select e.user_id, e.event_type, min(e.ts) from r join events e on e.user_id = r.user_id and e.event_type = r.event_type and e.ts >= r.ts + interval 1 hour group by e.user_id, e.event_type) select event_id, e.user_id, e.event_type, e.ts from events e join r on r.user_id = e.user_id and r.event_type = e.event_type and r.ts = e.ts"),
    (retry_state, K.with_views(_FAILED + " select run_id, seq, attempt, case when attempt < 3 then 'retry' else 'dead' end as route from f")),
    (dlq_route, K.with_views(_FAILED + " select run_id, seq from f where attempt = 3")),
    (dlq_replay, K.with_views(_FAILED + " select run_id, seq, ts, 'queued' as status from f where attempt = 3")),
    (run_status_final, K.with_views("select run_id, arg_max(status, row(ts, seq)) as status, count(*) as steps from kb_runs group by 1")),
    (metrics_histogram, "select event_type, le, count(*) filter (value <= le) as n from events, (values " + ", ".join(f"({float(b)}::double)" for b in BUCKETS) + ") b(le) group by 1, 2"),
    (p95_by_type, f"""
with b as (select event_type, le, count(*) filter (value <= le) as n from events, (values {", ".join(f"({float(b)}::double)" for b in BUCKETS)}) v(le) group by 1, 2),
t as (select event_type, count(*) as total from events group by 1),
p as (select b.event_type, le, n, total, lag(le, 1, 0.0::double) over w as lo, lag(n, 1, 0) over w as below from b join t on t.event_type = b.event_type window w as (partition by b.event_type order by le))
select t.event_type, coalesce(round(min(lo + (le - lo) * (0.95 * t.total - below) / (n - below)), 6), {float(BUCKETS[-1])}::double) as quantile, t.total as n
from t left join p on p.event_type = t.event_type and n >= 0.95 * t.total and below < 0.95 * t.total group by t.event_type, t.total"""),
    (event_rate, "select event_type, date_trunc('hour', ts) as start, count(*) as n, round(count(*) / 3600.0::double, 6) as per_second from events group by 1, 2"),
    (event_rate_sliding, "with p as (select event_type, time_bucket(interval 15 minutes, ts) as t, count(*) as n from events group by 1, 2), w as (select event_type, t - k * interval 15 minutes as start, n from p, range(4) r(k)) select event_type, start, cast(sum(n) as bigint) as n, round(sum(n) / 3600.0::double, 6) as per_second from w group by 1, 2"),
    (quantile_sliding, """
with v as (select event_type, date_trunc('hour', ts) as t, value, case when value > 0 then cast(ceil(ln(value) / ln(1.01::double / 0.99::double)) as bigint) when value < 0 then -cast(ceil(ln(-value) / ln(1.01::double / 0.99::double)) as bigint) end as b from events where value is not null),
w as (select event_type, t - k * interval 1 hour as start, value, b from v, range(6) r(k)),
r as (select *, row_number() over (partition by event_type, start order by value) as rnk, count(*) over (partition by event_type, start) as n from w)
select event_type, start, n, case when value = 0 then 0 else round(sign(value) * exp((case when value < 0 then -b else b end - 1) * ln(1.01::double / 0.99::double)) * 1.01::double, 6) end as quantile from r where rnk = greatest(1, ceil(0.95::double * n))"""),
    (counter_increase, """
with l as (select user_id, ts, cast(floor(value) as bigint) as v, lag(cast(floor(value) as bigint)) over (partition by user_id order by ts, floor(value)) as p from events),
g as (select user_id, time_bucket(interval 12 hours, ts) as t, case when p is null then 0 when v >= p then v - p else v end as grown from l),
w as (select user_id, t - k * interval 12 hours as start, grown from g, range(2) r(k))
select user_id, start, cast(sum(grown) as bigint) as increase from w group by 1, 2"""),
    (extraction_entities, f"""
with w as (select doc_id, source, unnest(string_split_regex(text, '[ \\n]')) as title, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) - 1 as nth from documents),
t as (select *, {_SLUG.format('title')} as slug, row_number() over (partition by doc_id, {_SLUG.format('title')} order by nth) as k from w where title <> '')
select doc_id, slug, nth, title, case when nth % 3 = 0 then 'product' else 'concept' end as entity_type, case when nth % 2 = 0 then concat('about ', title) else concat(title, ' extracted from ', source, '.') end as summary from t where k = 1"""),
    (extraction_claims, "with c as (select l_orderkey as doc_id, l_linenumber as nth, case when l_returnflag = 'N' then '' else l_returnflag end as entity_title, l_linestatus as text, round(greatest(0, least(1, case when l_linenumber % 3 > 0 then cast(l_discount as double) * 20 - 0.4::double else 0.7::double end)), 6) as confidence from lineitem) select *, 400 as quote_length from c where confidence >= 0.5"),
    (extraction_relations, "with r as (select l_orderkey % 1000 as doc_id, l_orderkey * 10 + l_linenumber as nth, l_returnflag as source_title, cast(l_suppkey % 5 as varchar) as target_title, case when l_linenumber > 2 then l_linestatus else 'related_to' end as relation_type from lineitem where l_returnflag <> 'N') select doc_id, min(nth) as nth, source_title, target_title, relation_type from r group by all"),
    (default_extraction, None),
    (pattern_list, K.with_views(""",
g as (select s_suppkey as pattern_id, replace(case s_suppkey % 4 when 0 then '/wiki/source/doc-%d*' when 1 then '/wiki/*/doc-%d.md' when 2 then '/sources/source/doc-?%d.md' else '/*-%d?.md' end, '%d', cast(s_suppkey as varchar)) as pattern from supplier),
m as (select pattern_id, path, kind, row_number() over (partition by pattern_id order by path) as position from g join kb_documents d on not archived and path glob replace(pattern, '/*', '/**'))
select pattern_id, cast(position as int) as position, concat('- `', path, '` [', kind, '] (ready)') as line from m where position <= 10""".replace("path glob replace(pattern, '/*', '/**')", "regexp_full_match(path, replace(replace(replace(pattern, '.', '\\.'), '*', '.*'), '?', '.'))"))),
    (read_requests, K.with_views(_BLOCKS.replace("with ", "") + """,
d as (select doc_id, concat('/wiki/c-', doc_id, '.md') as path, content_md from kb_markdown),
ch as (select doc_id, nth, trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) as chunk from (select *, max(case when heading then trim(line, '# ') end) over (partition by doc_id, nth) as title from pt) x where lower(title) = 'assistant' group by all),
se as (select doc_id, string_agg(chunk, chr(10) || chr(10) order by nth) as text from ch group by 1),
pg as (select conv_id as doc_id, string_agg(concat('## Page ', turn, chr(10), chr(10), text), chr(10) || chr(10) order by turn) as text from conversations where turn <= 2 group by 1),
ls as (select a.doc_id, string_agg(concat('- `', b.path, '` [wiki]'), chr(10) order by b.path) as text from d a join d b on b.doc_id // 10 = a.doc_id and b.doc_id >= 10 group by 1)
select d.doc_id as request_id, sha256(case d.doc_id % 5 when 0 then content_md when 1 then pg.text when 2 then concat('No pages found for `', path, '` and range `99`.') when 3 then coalesce(se.text, '') else coalesce(ls.text, concat('No documents match `wiki/c-', d.doc_id, '?.md`.')) end) as hash
from d left join se on se.doc_id = d.doc_id left join pg on pg.doc_id = d.doc_id left join ls on ls.doc_id = d.doc_id""")),
    (text_budget, "with t as (select conv_id as doc_id, string_agg(text, chr(10) || chr(10) order by turn) as t from conversations group by 1), c as (select doc_id, case when length(t) > 700 then concat(left(t, 700), chr(10), chr(10), '[truncated]') else t end as t from t) select doc_id, length(t) as n_chars, sha256(t) as hash from c"),
    (command_steps, K.with_views(_COMMANDS + """select doc_id * 2 as seq, path, 'append' as step_key, case when may then 'succeeded' else 'failed' end as status, case when not may then 'policy' end as error from p
union all select doc_id * 2 + 1, path, 'delete', case when may then 'succeeded' else 'failed' end, case when not may then 'policy' end from p where doc_id % 3 = 0
union all select seq, path, 'create', 'succeeded', null from n union all select seq + 1, path, 'create', 'failed', 'exists' from n""")),
    (command_documents, K.with_views(_COMMANDS + "select path, kind, policy, archived, case when archived then 'archived' else 'ready' end as status, head, sha256(content_md) as hash from e")),
    (head_pointers, K.with_views(_COMMANDS + "select path, head, sha256(content_md) as hash from e")),
    (queue_depths, K.with_views(", l as (select run_id, arg_max(status, row(ts, seq)) as status, count(*) filter (status = 'failed') as failures from kb_runs group by 1) select count(*) filter (status in ('queued', 'running')) as waiting, count(*) filter (failures >= 3) as dead from l")),
    (reclaim_idle, K.with_views(", l as (select run_id, arg_max(status, row(ts, seq)) as status, max(ts) as ts, count(*) filter (status = 'failed') as failures from kb_runs group by 1) select run_id, ts, failures + 1 as attempts, case when failures + 1 >= 3 then 'dead' else 'retry' end as route from l where status = 'running' and ts <= timestamp '2024-12-30 23:59:00' order by ts, run_id limit 10")),
    (props_filter, "select event_id from events where json_extract_string(props, '$.k') = '7'"),
    (vault_filter, K.with_views("select doc_id from kb_documents where contains(lower(path), 'src1') or contains(lower(title), 'src1') or contains(kind, 'src1')")),
    (search_limits, "select p_partkey, case when p_size * 2 - 10 <= 0 then 15 else least(50, p_size * 2 - 10) end as api, case when p_size * 2 - 10 > 0 then least(p_size * 2 - 10, 15) else 15 end as agent from part"),
    (block_upsert, """
with o as (select conv_id as doc_id, turn as chunk_idx, sha256(text) as h from conversations),
f as (select conv_id as doc_id, turn as chunk_idx, sha256(case when turn = 1 then concat(text, ' edited') else text end) as h from conversations where conv_id % 6 = 0 and turn < 3)
select o.doc_id, o.chunk_idx, coalesce(f.h, o.h) as content_hash, coalesce(f.h <> o.h, false) as written from o left join f on f.doc_id = o.doc_id and f.chunk_idx = o.chunk_idx
where f.h is not null or o.doc_id % 3 <> 0"""),
    (page_replace, "select conv_id as doc_id, turn as page_no, sha256(case when conv_id % 4 = 1 then concat(text, ' again') else text end) as hash from conversations where conv_id % 4 <> 1 or (conv_id % 8 = 1 and turn = 0)"),
    (page_listing, "select conv_id as doc_id, cast(row_number() over (partition by conv_id order by turn) as int) as position, turn as page_no, length(text) as char_count from conversations where conv_id % 5 = 2"),
    (pages_read, "select conv_id as doc_id, sha256(string_agg(text, chr(10) || chr(10) order by turn)) as hash from conversations where turn in (1, 2, 4) group by 1"),
    (reference_upsert, K.with_views("select source_document_id, target_document_id, ref_type, case when source_document_id % 2 = 0 then 'second' else 'first' end as metadata from kb_references")),
    (run_updates, """
with e as (select user_id as run_id, row(ts, event_id) as k, ts, case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' when 'signup' then 'running' end as status, event_type, props from events)
select run_id, arg_max(status, k) filter (status is not null) as status, arg_max(props, k) filter (event_type = 'purchase') as output, arg_max(props, k) filter (event_type = 'error') as error_message,
  min(ts) filter (event_type = 'signup') as started_at, max(ts) filter (event_type = 'purchase') as completed_at from e group by 1"""),
    (wiki_writes, K.with_views(_WRITES + "select path, doc_id * 2 as seq, op, false as created, sha256(one) as hash from w union all select path, doc_id * 2 + 1, 'append_content', false, sha256(two) from w where doc_id % 10 = 1 union all select path, seq, 'append_content', true, sha256(concat('About ', title)) from n")),
    (wiki_heads, K.with_views(_WRITES + "select d.path, d.kind, d.policy, sha256(case when w.doc_id is null then d.content_md when w.doc_id % 10 = 1 then two else one end) as hash from kb_documents d left join w on w.doc_id = d.doc_id union all select path, 'wiki', 'system_managed', sha256(concat('About ', title)) from n")),
    (overview_refresh, K.with_views(f""",
c as (select workspace_id, count(*) filter (kind = 'source') as s, count(*) filter (kind in ('wiki', 'system')) as w, arg_max(title, doc_id) filter (kind = 'source') as t, min(doc_id) filter (kind = 'source') as p from kb_documents where not archived group by 1),
e as (select *, concat('source-', {_SLUG.format('t')}, '["', replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br/>'), '"]') as node from c where s > 0)
select workspace_id, replace(concat('This workspace is an agent-native compiled knowledge vault.~~## Key Findings~~| Signal | Value |~| --- | --- |~| Sources | ', s, ' |~| Wiki Pages | ', w, ' |~| Latest Source | ', replace(t, '~', chr(1)), ' |~~```mermaid~graph TD~    ',
  replace(node, '~', chr(1)), ' --> compiler["Compiler"]~    compiler["Compiler"] --> compiled-wiki["Compiled Wiki"]~    compiled-wiki["Compiled Wiki"] --> hybrid-search["Hybrid Search"]~    compiled-wiki["Compiled Wiki"] --> agent-plane["Agent Operating Plane"]~```~~## Recent Updates~~- Processed source `',
  replace(t, '~', chr(1)), '`.~- Extracted ', s, ' semantic nodes.~- Created or updated ', p, ' wiki documents.~'), '~', chr(10)) as content_md, s as sources, w as pages from e""")),
    (claim_citations, K.with_views(", ln as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as chunk_idx from documents), m as (select claim_id, doc_id, chunk_idx, len(list_filter(list_filter(regexp_split_to_array(lower(quote_text), '\\s+'), lambda x: x <> '')[1:10], lambda x: contains(lower(t), x))) as overlap from kb_citations join ln on ln.doc_id = source_document_id where claim_id % 2 = 0), b as (select claim_id, doc_id, arg_max(chunk_idx, row(overlap, -chunk_idx)) as chunk_idx from m where overlap > 0 group by 1, 2) select c.claim_id, source_document_id as doc_id, coalesce(b.chunk_idx, 0) as chunk_idx, sha256(case when c.claim_id % 2 = 0 then quote_text else (select left(t, 400) from ln where ln.doc_id = source_document_id and ln.chunk_idx = 0) end) as hash, case when c.claim_id % 2 = 0 then 'exact_match' else 'fallback' end as precision from kb_citations c left join b on b.claim_id = c.claim_id and b.doc_id = source_document_id")),
    (paragraph_match, """
with t as (select conv_id as doc_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:15]) as w from conversations),
m as (select a.doc_id, a.turn as chunk_idx, b.turn as para_no, len(list_intersect(a.w, b.w)) as overlap from t a join t b on b.doc_id = a.doc_id where b.turn % 2 = 0)
select doc_id, chunk_idx, arg_max(para_no, row(overlap, -para_no)) as para_no, max(overlap) as overlap from m where overlap >= 3 group by 1, 2"""),
    (stream_routes, K.with_views(_FAILED + " select run_id, seq, attempt, case when attempt < 3 then 'retry' else 'dead' end as route from f")),
    (stream_run_lives, None),
    (stream_first_seen, "select distinct user_id, event_type from events"),
]

QUERIES = {f.__name__: f for f, _ in ENTRIES}
ORACLE_SQL = {f.__name__: sql for f, sql in ENTRIES if sql}
