"""Workspace and document-focused graph views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.sinks import stored
from tesserine.tables import ENTITY_KINDS

HIDDEN = ("/wiki/overview.md", "/wiki/log.md")


def entity_path(kind: Column, title: Column) -> Column:
    return F.concat(F.lit("/wiki/"), F.when(kind.isin(*ENTITY_KINDS), "entities").otherwise("concepts"), F.lit("/"), T.slugify(title), F.lit(".md"))


def _node(df: DataFrame, kind: str, ref: str, label: Column, subtype: Column, path: Column, ordinal: int) -> DataFrame:
    i = F.col(ref)
    return df.select(F.concat(F.lit(f"{kind}:"), i.cast("string")).alias("id"), F.lit(kind).alias("type"), i.alias("ref_id"), label.alias("label"), subtype.alias("subtype"), path.alias("path"), F.lit(ordinal).alias("_set"))


def _edge(df: DataFrame, kind: str, source: Column, target: Column, label: Column, ordinal: int) -> DataFrame:
    return df.select(F.concat_ws("|", F.lit(kind), source, target, label).alias("id"), F.lit(kind).alias("type"), source.alias("source"), target.alias("target"), label.alias("label"), F.lit(ordinal).alias("_set"))


def _at(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


class Graph:
    """Nodes, edges and summary; a node or edge met twice counts once, at its first place.

    Both lists are cut in the order entities, claims, documents (relations,
    claims, citations, references) and by id; then edges without both ends go.
    The documents of ``focus`` are nodes in any case and come first.  Ends are looked
    up by id before any label is built.  Each part is made when it is asked for: nodes
    need no edges, and only what two parts need is written.
    """

    def __init__(self, t: dict[str, DataFrame], entities: DataFrame, relations: DataFrame, claims: DataFrame, citations: DataFrame, references: DataFrame, max_nodes: int, max_edges: int, focus: DataFrame | None = None):
        self.docs, self.entities, self.relations, self.claims, self.references = t["documents"], entities, relations, claims, references
        self._citations, self.max_nodes, self.max_edges, self.focus = citations, max_nodes, max_edges, focus

    def _cut_nodes(self, citations: DataFrame) -> DataFrame:
        docs, references, focus = self.docs, self.references, self.focus
        named = citations.select(F.col("source_document_id").alias("doc_id")).unionByName(references.select(F.col("source_document_id").alias("doc_id"))).unionByName(references.select(F.col("target_document_id").alias("doc_id"))).distinct()
        document = lambda df, at: _node(df, "document", "doc_id", F.col("title"), F.col("kind"), F.col("path"), at)
        if focus is not None:
            named = named.join(focus.select("doc_id"), "doc_id", "left_anti")
        # of each set no more than the cut can be shown: documents are joined with their labels after it
        named = docs.select("doc_id").join(named, "doc_id", "left_semi").orderBy("doc_id").limit(self.max_nodes)
        nodes = (
            _node(self.entities, "entity", "entity_id", F.col("title"), F.col("entity_type"), entity_path(F.col("entity_type"), F.col("title")), 0)
            .unionByName(_node(self.claims, "claim", "claim_id", T.shorten(F.col("canonical_text"), 120, "…"), F.lit(None).cast("string"), F.lit(None).cast("string"), 1))
            .unionByName(document(docs.join(named, "doc_id", "left_semi"), 2))
        )
        if focus is not None:
            nodes = nodes.unionByName(document(docs.join(focus.select("doc_id"), "doc_id", "left_semi"), -1))
        return nodes.orderBy("_set", "ref_id").limit(self.max_nodes)

    @property
    def nodes(self) -> DataFrame:
        return self._cut_nodes(self._citations).drop("_set")

    @cached_property
    def _stored(self) -> tuple[DataFrame, DataFrame]:
        """Citations and the nodes that are shown: edges need both twice."""
        citations = stored(self._citations, "citations")
        return citations, stored(self._cut_nodes(citations), "nodes")

    @cached_property
    def _cut_edges(self) -> DataFrame:
        citations = self._stored[0]
        # an edge needs both ends among all nodes before the lists are cut
        related = _within(_within(self.relations, self.entities, "entity_id", "source_entity_id"), self.entities, "entity_id", "target_entity_id")
        related = related.select("source_entity_id", "target_entity_id", "relation_type").distinct()
        supporting = _within(self.claims, self.entities, "entity_id", "entity_id")
        cited = _within(_within(citations, self.claims, "claim_id", "claim_id"), self.docs, "doc_id", "source_document_id")
        referring = _within(_within(self.references, self.docs, "doc_id", "source_document_id"), self.docs, "doc_id", "target_document_id")
        edges = (
            _edge(related, "relation", _at("entity", "source_entity_id"), _at("entity", "target_entity_id"), F.col("relation_type"), 0)
            .unionByName(_edge(supporting, "claim_entity", _at("claim", "claim_id"), _at("entity", "entity_id"), F.lit("supports"), 1))
            .unionByName(_edge(cited, "citation", _at("claim", "claim_id"), _at("document", "source_document_id"), F.lit("cites"), 2))
            .unionByName(_edge(referring, "reference", _at("document", "source_document_id"), _at("document", "target_document_id"), F.col("ref_type"), 3))
        )
        return stored(edges.orderBy("_set", "id").limit(self.max_edges), "edges")

    def _shown_edges(self) -> DataFrame:
        cut = self._cut_edges
        for end in ("source", "target"):
            cut = _within(cut, self._stored[1], "id", end)
        return cut

    @property
    def edges(self) -> DataFrame:
        return self._shown_edges().select("id", "type", "source", "target", "label")

    @property
    def summary(self) -> DataFrame:
        shown, cut = self._stored[1], self._shown_edges()
        over = shown.agg(F.count("*").alias("n")).crossJoin(self._cut_edges.agg(F.count("*").alias("e")))  # one row each
        kinds = [F.count_if(F.col("type") == k).alias(f"{k}_nodes") for k in ("entity", "claim", "document")]
        links = [F.count_if(F.col("type") == k).alias(f"{k}_edges") for k in ("relation", "claim_entity", "citation", "reference")]
        return shown.agg(*kinds).crossJoin(cut.agg(*links)).crossJoin(over.select(((F.col("n") >= self.max_nodes) | (F.col("e") >= self.max_edges)).alias("truncated")))


def _within(e: DataFrame, n: DataFrame, key: str, c: str) -> DataFrame:
    return e.join(n.select(F.col(key).alias(c)), c, "left_semi")


def _without(df: DataFrame, hidden: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(hidden.select(F.col("doc_id").alias(c)), c, "left_anti")
    return df


def _included(claims: DataFrame, citations: DataFrame, references: DataFrame, include_claims: bool, include_documents: bool, include_references: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations need claims and documents, references need documents."""
    only = lambda df, wanted: df if wanted else df.filter(F.lit(False))
    return only(claims, include_claims), only(citations, include_claims and include_documents), only(references, include_references and include_documents)


def workspace_graph(t: dict[str, DataFrame], max_nodes: int = 300, max_edges: int = 600, include_claims: bool = True, include_documents: bool = True, include_references: bool = True) -> Graph:
    """Everything, without citations of the structural pages and references from or to them."""
    hidden = t["documents"].filter(F.col("path").isin(*HIDDEN)).select("doc_id")
    parts = _included(t["claims"].filter("entity_id is not null"), _without(t["citations"], hidden, "source_document_id"), _without(t["references"], hidden, "source_document_id", "target_document_id"), include_claims, include_documents, include_references)
    return Graph(t, t["entities"], t["relations"], *parts, max_nodes, max_edges)


def focus_graph(t: dict[str, DataFrame], focus: DataFrame, max_nodes: int = 300, max_edges: int = 600, include_claims: bool = True, include_documents: bool = True, include_references: bool = True) -> Graph:
    """The documents of ``focus`` (doc_id) and what surrounds them: cited claims, their entities, relations between those, references in both directions."""
    cited = t["citations"].join(focus.select(F.col("doc_id").alias("source_document_id")), "source_document_id", "left_semi")
    claims = t["claims"].join(cited.select("claim_id"), "claim_id", "left_semi")
    near = claims.select("entity_id").filter("entity_id is not null").distinct()
    entities = t["entities"].join(near, "entity_id", "left_semi")
    touching = t["relations"].join(near.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_semi")
    f = focus.select("doc_id")
    out = t["references"].join(f.withColumnRenamed("doc_id", "source_document_id"), "source_document_id", "left_semi")
    into = t["references"].join(f.withColumnRenamed("doc_id", "target_document_id"), "target_document_id", "left_semi")
    parts = _included(claims, cited, out.unionByName(into).distinct(), include_claims, include_documents, include_references)
    return Graph(t, entities, touching, *parts, max_nodes, max_edges, f if include_documents else None)


def neighbours(documents: DataFrame, references: DataFrame) -> DataFrame:
    """Each reference with path and title of both its documents."""
    side = lambda k: documents.select(F.col("doc_id").alias(f"{k}_document_id"), F.col("path").alias(f"{k}_path"), F.col("title").alias(f"{k}_title"))
    return references.join(side("source"), "source_document_id").join(side("target"), "target_document_id")


def document_citations(citations: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.select(F.col("doc_id").alias("source_document_id"), "path")
    return citations.join(claims.select("claim_id", "canonical_text", "confidence"), "claim_id", "left").join(d, "source_document_id")
