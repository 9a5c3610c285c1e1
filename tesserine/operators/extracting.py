"""What a document speaks of: the cleaning of raw extractions, and an extractor that needs no model.

The extractor takes runs of words with capitals as phrases.  Phrases that stand near each
other in a block are joined by an edge, and a power iteration over the graph of the whole
corpus ranks them.  The best phrases of each document are its entities, the first sentence with one
is a claim about it, and entities of one sentence are related.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as T
from tesserine.sinks import stored

#: What stands for what a raw extraction leaves out, and the length of a quote.
TYPE, CONFIDENCE, RELATION, QUOTE = "concept", 0.7, "related_to", 400
#: Entities of a document at most, steps of the power iteration, its damping, and how near phrases are neighbours.
ENTITIES, STEPS, DAMPING, NEAR = 20, 10, 0.85, 2
#: A run of up to four words that begin with a capital.
PHRASE = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+){0,3}"
#: Ids that a broadcast may hold, and links of a part of the graph.
SMALL, LINKS = 500_000, 4_000_000
#: Where a sentence ends.
SENTENCE = r"(?<=[.!?])\s+|\n+"


def _first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; a minimum, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def _summary(title: Column, summary: Column, source: Column) -> Column:
    return F.coalesce(summary, F.concat(title, F.lit(" extracted from "), F.coalesce(source, F.lit("")), F.lit(".")))


def clean_entities(raw: DataFrame) -> DataFrame:
    """doc_id, source_title, nth, title, entity_type, summary -> doc_id, slug, nth, title, entity_type, summary.

    Titles are trimmed, blank ones go, the first of a slug stays; a missing type or
    summary has its default.
    """
    title = T.trim(F.col("title"))
    rows = raw.withColumn("title", title).filter(F.coalesce(F.col("title") != "", F.lit(False)))
    rows = rows.select("doc_id", T.slugify(F.col("title")).alias("slug"), "nth", "title", F.coalesce("entity_type", F.lit(TYPE)).alias("entity_type"), _summary(F.col("title"), F.col("summary"), F.col("source_title")).alias("summary"))
    return _first(rows, ["doc_id", "slug"], "nth").select("doc_id", "slug", "nth", "title", "entity_type", "summary")


def clean_entity_lists(lists: DataFrame) -> DataFrame:
    """The same of doc_id, source_title, raw: a list of (nth, title, entity_type, summary), as an extraction returns it.

    A list is cleaned where it stands: sorted by slug and place, the first of each slug
    stays.  Only documents with several lists are shuffled, and what the
    cleaning of their lists left.
    """
    ids = lists.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id")
    ids = stored(ids, "repeated")
    repeated = ids.count()
    trimmed = F.filter(F.transform("raw", lambda x: F.struct(x["nth"].alias("nth"), T.trim(x["title"]).alias("title"), x["entity_type"].alias("entity_type"), x["summary"].alias("summary"))), lambda x: F.coalesce(x["title"] != "", F.lit(False)))
    slugs = F.transform(trimmed, lambda x: F.struct(T.slugify(x["title"]).alias("slug"), x["nth"].alias("nth"), x["title"].alias("title"), x["entity_type"].alias("entity_type"), x["summary"].alias("summary")))
    sorted_ = lists.select("doc_id", "source_title", F.array_sort(slugs).alias("_s"))
    first = F.filter("_s", lambda x, i: (i == 0) | (F.get("_s", i - 1)["slug"] != x["slug"]))
    rows = sorted_.select("doc_id", "source_title", F.inline(first))
    rows = rows.select("doc_id", "slug", "nth", "title", F.coalesce("entity_type", F.lit(TYPE)).alias("entity_type"), _summary(F.col("title"), F.col("summary"), F.col("source_title")).alias("summary"))
    if not repeated:
        return rows
    # counted: broadcast only if there are few
    few, same = F.broadcast(ids) if repeated <= SMALL else ids, F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(few, same, "left_anti").unionByName(_first(rows.join(few, same, "left_semi"), ["doc_id", "slug"], "nth").select(*rows.columns))


def clean_claims(raw: DataFrame, least: float) -> DataFrame:
    """doc_id, nth, entity_title, text, confidence, quote -> the same: confidence in 0..1 and not below ``least``, quotes cut at QUOTE."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(CONFIDENCE))))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.select("doc_id", "nth", empty("entity_title"), empty("text"), conf.alias("confidence"), F.left(F.coalesce("quote", F.lit("")), F.lit(QUOTE)).alias("quote")).filter(F.col("confidence") >= least)


def clean_relations(raw: DataFrame) -> DataFrame:
    """doc_id, nth, source_title, target_title, relation_type -> the first of each, without those that lack an end."""
    rows = raw.filter(F.coalesce((F.col("source_title") != "") & (F.col("target_title") != ""), F.lit(False)))
    rows = rows.withColumn("relation_type", F.coalesce("relation_type", F.lit(RELATION)))
    return _first(rows.select("doc_id", "source_title", "target_title", "relation_type", "nth"), ["doc_id", "source_title", "target_title", "relation_type"], "nth")


def _phrases(blocks: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, phrases: the phrases of each block in order."""
    return blocks.select("doc_id", "chunk_idx", F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0)).alias("phrases"))


def cooccurrences(blocks: DataFrame, near: int = NEAR) -> DataFrame:
    """a, b, n: how often two phrases stand within ``near`` of each other in a block; both directions."""
    pairs = _phrases(blocks).filter(F.size("phrases") > 1)

    def shifted(k: int) -> Column:
        return F.arrays_zip(F.slice("phrases", F.lit(1), F.size("phrases") - k).alias("a"), F.slice("phrases", F.lit(k + 1), F.size("phrases") - k).alias("b"))

    parts = [F.when(F.size("phrases") > k, shifted(k)).otherwise(F.array().cast("array<struct<a:string,b:string>>")) for k in range(1, near + 1)]
    one = pairs.select(F.inline(F.flatten(F.array(*parts)))).filter("a <> b")
    counted = stored(one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")), "pairs")
    return counted.select(F.inline(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))))


def ranks(edges: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """phrase, rank of a graph a, b, n by power iteration; ranks have the mean 1.

    What a phrase gives goes to its neighbours by weight; the sums combine before
    the shuffle, so a phrase with very many neighbours is no heavy group.  Ranks are
    rounded in every step: the order of adding does not show.  The links are shuffled
    once and kept where they are by the phrase that gives, so a step moves ranks and sums of
    a part only; large parts (LINKS) leave few sums.
    """
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // LINKS))
    dealt = edges.select("a", "b", "n").repartition(parts, "a").sortWithinPartitions("a").persist()
    dealt.count()  # what is cached lies in a known order for what is planned from here
    links = dealt.join(dealt.groupBy("a").agg(F.sum("n").alias("total")), "a").select("a", "b", "n", "total").persist()
    links.count()
    dealt.unpersist()
    share = F.col("n") / F.col("total")
    now = links.select("a").distinct().withColumn("rank", F.lit(1.0))
    for _ in range(steps):
        # the cast rounds
        given = links.join(now.repartition(parts, "a"), "a").groupBy("b").agg(F.sum((share * F.col("rank")).cast("decimal(30,12)")).cast("double").alias("got"))
        now = given.select(F.col("b").alias("a"), F.round(1 - damping + damping * F.col("got"), 9).alias("rank"))
    ranked = stored(now.select(F.col("a").alias("phrase"), "rank"), "ranks")
    links.unpersist()
    return ranked


def _firsts(blocks: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, phrase, pos: the phrases of each block, each with the first sentence it stands in."""
    spots = F.flatten(F.transform(F.split("text", SENTENCE), lambda s, i: F.transform(F.array_distinct(F.regexp_extract_all(s, F.lit(PHRASE), F.lit(0))), lambda p: F.struct(p.alias("phrase"), i.alias("pos")))))
    sorted_ = blocks.select("doc_id", "chunk_idx", F.array_sort(spots).alias("_s"))
    return sorted_.select("doc_id", "chunk_idx", F.inline(F.filter("_s", lambda x, i: (i == 0) | (F.get("_s", i - 1)["phrase"] != x["phrase"]))))


def extract(blocks: DataFrame, titles: DataFrame, most: int = ENTITIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw entities, claims and relations of blocks (doc_id, chunk_idx, text) of documents (doc_id, title).

    The ``most`` phrases of highest rank of each document, ties by the phrase; phrases
    without a neighbour have the rank that no neighbour gives.  Phrases travel with the
    place of their sentence; the sentences themselves are looked up in the texts, which are
    shuffled once, when claims are asked for.
    """
    ranked = ranks(cooccurrences(blocks))
    rank = F.coalesce("rank", F.lit(1 - DAMPING))
    # one shuffle by document, for the first place of each phrase as for the order
    each = _firsts(blocks).join(ranked, "phrase", "left").select("doc_id", "phrase", "chunk_idx", "pos", rank.alias("rank")).repartition("doc_id")
    found = each.groupBy("doc_id", "phrase", "rank").agg(F.min(F.struct("chunk_idx", "pos")).alias("at"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank"), "phrase")
    top = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    # ``most`` at most
    best = stored(top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "phrase", "rank", "at"))).alias("best")), "entities")
    listed = best.join(titles.select("doc_id", F.col("title").alias("source_title")), "doc_id", "left").select("doc_id", "source_title", F.inline("best"))
    entities = listed.select("doc_id", "source_title", "nth", F.col("phrase").alias("title"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("summary"))
    # a struct is equal to another also where the id is null
    key = F.struct("doc_id").alias("_k")
    texts = blocks.select(key, "chunk_idx", F.split("text", SENTENCE).alias("sentences"))
    quoted = texts.join(best.select(key, "best"), "_k").select("_k", F.inline(F.transform(F.filter("best", lambda x: x["at"]["chunk_idx"].eqNullSafe(F.col("chunk_idx"))), lambda x: F.struct(x["nth"].alias("nth"), x["phrase"].alias("phrase"), x["rank"].alias("rank"), F.get("sentences", x["at"]["pos"]).alias("sentence")))))
    # where blocks have the same id and place, a sentence that holds the phrase
    quoted = quoted.filter(F.array_contains(F.regexp_extract_all("sentence", F.lit(PHRASE), F.lit(0)), F.col("phrase"))).groupBy("_k", "nth", "phrase", "rank").agg(F.min("sentence").alias("sentence"))
    # a rank of 1 is the mean
    claims = quoted.select("_k.doc_id", "nth", F.col("phrase").alias("entity_title"), F.col("sentence").alias("text"), F.round(F.col("rank") / (1 + F.col("rank")), 6).alias("confidence"), F.col("sentence").alias("quote"))
    sentences = blocks.select("doc_id", "chunk_idx", F.posexplode(F.split("text", SENTENCE)).alias("pos", "sentence"))
    held = sentences.select("doc_id", "chunk_idx", "pos", F.array_distinct(F.regexp_extract_all("sentence", F.lit(PHRASE), F.lit(0))).alias("phrases"))
    chosen = best.select("doc_id", F.col("best.phrase").alias("chosen"))
    lines = held.join(chosen, "doc_id").select("doc_id", "chunk_idx", "pos", F.array_intersect("phrases", "chosen").alias("p")).filter(F.size("p") > 1)
    steps = lines.select("doc_id", "chunk_idx", "pos", F.inline(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("source_title"), F.slice("p", F.lit(2), F.size("p") - 1).alias("target_title"))))
    relations = steps.groupBy("doc_id", "source_title", "target_title").agg(F.min(F.struct("chunk_idx", "pos")).alias("nth")).withColumn("relation_type", F.lit(None).cast("string"))
    return entities, claims, relations


def extract_clean(blocks: DataFrame, titles: DataFrame, least: float = 0.5, most: int = ENTITIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The extractor and the cleaning: entities, claims, relations."""
    entities, claims, relations = extract(blocks, titles, most)
    return clean_entities(entities), clean_claims(claims, least), clean_relations(relations)
