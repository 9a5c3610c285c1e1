"""Hybrid retrieval: full-text, vector, title and entity channels, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as T
from tesserine.functions import vectors as V
from tesserine.operators import fulltext

RRF_K, SNIPPET, HEAD = 60, 300, 20
#: Name -> default, least, most of the search rules.
RULES = {"default_limit": (20, 5, 50), "graph_boost_weight": (0.15, 0.0, 1.0), "min_score": (0.0, 0.0, 1.0)}
#: The same for the compile rules.
COMPILE_RULES = {"max_entities": (20, 5, 50), "min_confidence": (0.5, 0.0, 1.0), "text_truncation_limit": (12_000, 4_000, 30_000)}


def clamp_rule(value: Column, rule: tuple) -> Column:
    default, least, most = (F.lit(float(x)) for x in rule)
    return F.greatest(least, F.least(most, F.coalesce(value.cast("double"), default)))


def query_tokens(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def match_all(df: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text holds every token of the query; score = how often they occur in it.

    The occurrences are counted inside each row: no token table, no shuffle.
    """
    wanted = query_tokens(query)
    if not wanted:
        return df.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    found = df.withColumns({f"_n{i}": T.count_of(text, w) for i, w in enumerate(wanted)})
    for i in range(len(wanted)):
        found = found.filter(F.col(f"_n{i}") > 0)
    total = sum((F.col(f"_n{i}") for i in range(1, len(wanted))), F.col("_n0"))
    return found.withColumn("score", total.cast("double")).drop(*[f"_n{i}" for i in range(len(wanted))])


def top(df: DataFrame, limit: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("score"), *ties).limit(limit)


def _hit(df: DataFrame, kind: str, key: str, ref: str, page: Column, body: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{key}:"), F.col(ref).cast("string")).alias("id"), F.lit(kind).alias("result_type"), "path", "title", page.cast("int").alias("page_no"), F.round("score", 6).alias("score"), F.left(body, F.lit(SNIPPET)).alias("snippet"))


def _indexed(df: DataFrame, key: str, index: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best rows of ``df`` by an index of their text, with ``score``; ties go by the key as text, as in a scan."""
    plain = " ".join(query_tokens(query))
    hits, _ = fulltext.search(index, [plain], limit, within=df.select(F.col(key).cast("long").alias("id")), tie=lambda i: i.cast("string"))
    return df.join(F.broadcast(hits.select(F.col("id").alias(key), "score")), key)  # ``limit`` rows


def lexical_blocks(blocks: DataFrame, query: str, limit: int, index: DataFrame | None = None) -> DataFrame:
    """Blocks that hold every word of the query, those with most of them first; by an index of their text (``fulltext.build``) if there is one."""
    found = match_all(blocks, F.col("text"), query) if index is None else _indexed(blocks, "block_id", index, query, limit)
    return top(_hit(found, "block", "block", "block_id", F.col("page_no"), "text"), limit, "id")


def title_match(documents: DataFrame, query: str, limit: int, index: DataFrame | None = None) -> DataFrame:
    """The same for the titles of pages."""
    pages = documents.filter("not archived and kind in ('wiki', 'system')")
    found = match_all(pages, F.col("title"), query) if index is None else _indexed(pages, "doc_id", index, query, limit)
    return top(_hit(found, "document", "document", "doc_id", F.lit(None), "content_md"), limit, "id")


def like_pattern(text: str, escape: bool = False) -> str:
    """A substring pattern; the wildcards of the text act as such unless they are escaped."""
    return f"%{text.replace('%', chr(92) + '%').replace('_', chr(92) + '_') if escape else text}%"


def entity_match(entities: DataFrame, query: str, limit: int, escape: bool = False) -> DataFrame:
    """Entities whose title or summary holds the query, without regard to case; newest (largest id) first."""
    p = like_pattern(query, escape)
    path = F.concat(F.lit("/wiki/entities/"), T.slugify(F.col("title")), F.lit(".md"))
    found = entities.filter(F.col("title").ilike(p) | F.col("summary").ilike(p)).withColumns({"score": F.lit(1.0), "path": path})
    return _hit(found.orderBy(F.desc("entity_id")).limit(limit), "entity", "entity", "entity_id", F.lit(None), "summary")


def nearest(blocks: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """The blocks of largest cosine.  ``vector`` has one row and column ``query``."""
    near = blocks.filter("embedding is not null").join(F.broadcast(vector.limit(1))).withColumn("score", V.cosine(F.col("embedding"), F.col("query")))
    return top(_hit(near, "semantic_block", "block", "block_id", F.col("page_no"), "text"), limit, "id")


def fuse(channels: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) by id; the fields are those of the highest raw score, the earlier channel on ties.

    The channels are top-k lists, so their ranks are over a few rows.
    """
    order = Window.partitionBy("channel").orderBy(F.desc("score"), "id")
    rows = None
    for i, c in enumerate(channels):
        one = c.withColumn("channel", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    ranked = rows.withColumn("rank", F.row_number().over(order))
    fields = F.struct("result_type", "path", "title", "page_no", "snippet")
    best = F.max_by(fields, F.struct(F.coalesce("score", F.lit(0.0)), -F.col("channel")))
    fused = ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), best.alias("best"), F.min(F.struct("channel", "rank")).alias("first"))
    return fused.select("id", "best.*", F.round("fused", 6).alias("score"), "first")


def graph_weights(documents: DataFrame, references: DataFrame, citations: DataFrame) -> DataFrame:
    """path, weight: references to a document plus citations of it."""
    incoming = references.groupBy(F.col("target_document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    cited = citations.groupBy(F.col("source_document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    weight = incoming.unionByName(cited).groupBy("doc_id").agg(F.sum("n").alias("weight"))
    return documents.filter("not archived").join(weight, "doc_id", "left").select("doc_id", "path", F.coalesce("weight", F.lit(0)).alias("weight"))


def boost(hits: DataFrame, weights: DataFrame, by: float) -> DataFrame:
    """score += weight / (largest weight, 1 at least) * by, for the document at the hit's path."""
    most = weights.agg(F.greatest(F.lit(1), F.max("weight")).alias("most"))
    found = hits.join(weights.select("path", "weight"), "path", "left").join(F.broadcast(most))
    bonus = F.coalesce(F.col("weight"), F.lit(0)) / F.col("most") * by
    return found.withColumn("score", F.round(F.col("score") + bonus, 6)).drop("weight", "most")


def heuristic_rerank(hits: DataFrame, query: str, head: int = HEAD) -> DataFrame:
    """The first ``head`` hits get the share of query tokens that they hold as score and are ordered by it; the rest follows.

    hits has ``position`` (1..); so has the result.
    """
    wanted = query_tokens(query)
    if not wanted:
        return hits
    words = F.array(*map(F.lit, wanted))
    body = F.coalesce(F.nullif("snippet", F.lit("")), "title", F.lit(""))
    cover = F.round(F.size(F.array_intersect(words, T.tokens(body))) / len(wanted), 6)
    scored = hits.withColumn("score", F.when(F.col("position") <= head, cover).otherwise(F.col("score")))
    order = Window.orderBy((F.col("position") > head).cast("int"), F.when(F.col("position") <= head, -F.col("score")), "position")  # over a result list
    return scored.withColumn("position", F.row_number().over(order))


def rerank(hits: DataFrame, query: str, scorer: Callable[[DataFrame, str], DataFrame] | None = None, head: int = HEAD) -> DataFrame:
    """The first ``head`` hits in the order of ``scorer``, the rest after them; without a scorer the heuristic.

    ``scorer`` gets hits and query and returns id and score (a remote model, say).
    Hits that it leaves out keep their score.
    """
    if scorer is None:
        return heuristic_rerank(hits, query, head)
    scores = scorer(hits.filter(F.col("position") <= head), query).select("id", F.col("score").alias("_new"))
    found = hits.join(scores, "id", "left").withColumn("score", F.when(F.col("position") <= head, F.coalesce("_new", "score")).otherwise(F.col("score"))).drop("_new")
    order = Window.orderBy((F.col("position") > head).cast("int"), F.when(F.col("position") <= head, -F.col("score")), "position")  # over a result list
    return found.withColumn("position", F.row_number().over(order))


def api_limit(limit: Column, default: Column, most: int = 50) -> Column:
    """0 or less stands for the workspace's default; no more than ``most``."""
    return F.when(limit <= 0, default).otherwise(F.least(F.lit(most), limit))


def agent_limit(limit: Column, default: Column, argument: int = 10) -> Column:
    """The workspace's default for 0 or less, and no more than it; ``argument`` where no limit was given (null)."""
    given = F.coalesce(limit, F.lit(argument))
    return F.when(given > 0, F.least(given, default)).otherwise(default)


def hybrid_search(tables: dict[str, DataFrame], query: str, vector: DataFrame | None, limit: int = 20, boost_by: float = 0.15, min_score: float = 0.0, rerank: bool = True, texts: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """All channels, fused, boosted, cut and reranked: one lazy plan.  ``texts`` and ``titles`` are indexes of the blocks' texts and the documents' titles."""
    channels = [lexical_blocks(tables["blocks"], query, limit, texts)]
    if vector is not None:
        channels.append(nearest(tables["blocks"], vector, limit))
    channels += [title_match(tables["documents"], query, limit, titles), entity_match(tables["entities"], query, limit)]
    hits = fuse(channels)
    if boost_by:
        hits = boost(hits, graph_weights(tables["documents"], tables["references"], tables["citations"]), boost_by)
    if min_score > 0:
        hits = hits.filter(F.col("score") >= min_score)
    hits = hits.orderBy(F.desc("score"), "first", "id").limit(limit)
    hits = hits.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "first", "id"))).drop("first")  # over the result list
    return heuristic_rerank(hits, query) if rerank else hits


def with_tags(hits: DataFrame, documents: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The hits whose document has one of the tags, without regard to case; filters what the search returned."""
    wanted = F.array(*[F.lit(t.lower()) for t in tags])
    tagged = documents.filter(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), wanted))
    return hits.join(tagged.select("path"), "path", "left_semi")
