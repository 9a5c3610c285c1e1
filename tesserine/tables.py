"""The knowledge tables, as views over the test tables, and the allowed values of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.quotes import contained
from tesserine.operators.scans import following
from tesserine.session import spread

# What the columns of these names may hold.
KINDS = ("source", "wiki", "system", "asset")
STATUSES = ("draft", "queued", "processing", "ready", "failed", "archived")
POLICIES = ("system_managed", "agent_editable", "append_only", "locked")
RUN_STATUSES = ("queued", "running", "succeeded", "failed")
ENTITY_KINDS = ("person", "company", "organization", "project", "product", "protocol", "event")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(value, *choices: str):
    """The choice at a number's place."""
    out = F.lit(choices[-1])
    for i, c in reversed(list(enumerate(choices[:-1]))):
        out = F.when(value == i, c).otherwise(out)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, marks = spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "toxic")
    kind = pick(d.doc_id % 5, "source", "wiki", "wiki", "wiki", "system")
    folder = F.when(d.doc_id % 5 == 0, "sources").otherwise("wiki")
    return d.join(marks, d.doc_id == F.col("_id"), "left").select(
        "doc_id",
        F.col("lang").alias("workspace_id"),
        F.concat(F.lit("/"), folder, F.lit("/"), "source", F.lit("/doc-"), d.doc_id.cast("string"), F.lit(".md")).alias("path"),
        F.left("text", F.lit(60)).alias("title"),
        kind.alias("kind"),
        pick(d.doc_id % 4, "system_managed", "agent_editable", "append_only", "locked").alias("policy"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("content_md"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter("not archived")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(e, "doc_id", "left").select(F.col("doc_id").alias("block_id"), "doc_id", "workspace_id", "path", "title", F.lit(1).alias("page_no"), F.col("content_md").alias("text"), "embedding")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = pick(p.p_partkey % 8, "person", "company", "project", "protocol", "concept")
    return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("title"), kind.alias("entity_type"), F.concat("p_brand", F.lit(" "), "p_type").alias("summary"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source_entity_id"), F.concat(F.lit("rel_"), "l_returnflag").alias("relation_type"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_entity_id"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("source_entity_id", "target_entity_id", "relation_type", F.col("l_orderkey").alias("source_document_id"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(i.alias("claim_id"), ((i * 7) % 20 + 1).alias("entity_id"), F.col("text").alias("canonical_text"), (((i * 37) % 100).cast("double") / 100).alias("confidence"), F.col("text").alias("quote"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document refers to the next one of its source."""
    rows = following(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", "target_document_id")
    rows = rows.select(F.col("doc_id").alias("source_document_id"), "target_document_id")
    return rows.filter("target_document_id is not null").withColumn("ref_type", F.lit("related"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose whole text stands in a document."""
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("quote"))
    found = contained(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), quotes).join(quotes, "claim_id")
    return found.select("claim_id", F.col("doc_id").alias("source_document_id"), F.left("quote", F.lit(400)).alias("quote_text"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("revision_id"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), F.concat("event_type", F.lit(" "), "props").alias("content_md"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "succeeded").otherwise("running")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), "ts", status.alias("status"))


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown text per conversation: doc_id, content_md."""
    turn = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n\n"))
    # a conversation's turns are one document, so the list is bounded by a document
    ordered = F.array_sort(F.collect_list(F.struct("turn", turn.alias("md"))))
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("# Conversation "), F.first("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform(ordered, lambda x: x["md"]), "")).alias("content_md"))


#: The same views for the SQL side.
SQL = """
kb_documents as (
  select d.doc_id, d.lang as workspace_id, concat('/', case when d.doc_id % 5 = 0 then 'sources' else 'wiki' end, '/', d.source, '/doc-', cast(d.doc_id as varchar), '.md') as path,
    left(d.text, 60) as title, case when d.doc_id % 5 = 0 then 'source' when d.doc_id % 5 = 4 then 'system' else 'wiki' end as kind,
    case when d.doc_id % 4 = 0 then 'system_managed' when d.doc_id % 4 = 1 then 'agent_editable' when d.doc_id % 4 = 2 then 'append_only' else 'locked' end as policy,
    coalesce(l.toxic, 0) = 1 as archived, [d.lang, d.source] as tags, d.text as content_md
  from documents d left join labels l on l.doc_id = d.doc_id),
kb_blocks as (
  select d.doc_id as block_id, d.doc_id, d.workspace_id, d.path, d.title, 1 as page_no, d.content_md as text, e.embedding
  from kb_documents d left join embeddings e on e.vec_id = d.doc_id where not d.archived),
kb_entities as (
  select p_partkey as entity_id, p_name as title, case when p_partkey % 8 = 0 then 'person' when p_partkey % 8 = 1 then 'company' when p_partkey % 8 = 2 then 'project' when p_partkey % 8 = 3 then 'protocol' else 'concept' end as entity_type,
    concat(p_brand, ' ', p_type) as summary from part),
kb_relations as (
  select a.l_partkey as source_entity_id, b.l_partkey as target_entity_id, concat('rel_', a.l_returnflag) as relation_type, a.l_orderkey as source_document_id
  from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
kb_claims as (
  select item_id as claim_id, (item_id * 7) % 20 + 1 as entity_id, text as canonical_text, cast((item_id * 37) % 100 as double) / 100 as confidence, text as quote from benchmark),
kb_citations as (
  select b.item_id as claim_id, d.doc_id as source_document_id, left(b.text, 400) as quote_text from benchmark b join documents d on contains(d.text, b.text)),
kb_references as (
  select doc_id as source_document_id, nxt as target_document_id, 'related' as ref_type
  from (select doc_id, lead(doc_id) over (partition by source order by doc_id) as nxt from documents) x where nxt is not null),
kb_revisions as (
  select event_id as revision_id, user_id as document_id, ts as created_at, concat(event_type, ' ', props) as content_md from events),
kb_runs as (
  select event_id as seq, user_id as run_id, ts, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'succeeded' else 'running' end as status from events),
kb_markdown as (
  select conv_id as doc_id, concat('# Conversation ', cast(conv_id as varchar), chr(10), chr(10), string_agg(concat('## ', role, chr(10), chr(10), text, chr(10), chr(10)), '' order by turn)) as content_md
  from conversations group by conv_id)
"""


def with_views(sql: str) -> str:
    """A query over the views as one statement over the test tables."""
    return f"with recursive {SQL.strip()}\n{sql}" if not sql.lstrip().startswith(",") else f"with recursive {SQL.strip()}{sql}"
