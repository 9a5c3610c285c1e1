"""An inverted index as a table: posting blocks by term, and top-k search that leaves out blocks that cannot enter.

A block is one row: a term, a range of WIDTH ids, and the ids of that range that hold
the term, with how often and where; ``top`` is the most occurrences in one of them.  Each file
is laid out by term, so that a query reads the row groups of its terms; the bounds are
read without the lists.  A frequent term is many blocks, none of which holds more than WIDTH ids.

Many queries are answered in one pass.  For each query and range the sum of the ``top``
of its words bounds what any id of the range can score.  The FIRST ranges with the largest
bounds are read; the score of the k-th hit found there is what a range has to reach to
be read as well.  The hits are those of a scan of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as T

WIDTH, FIRST = 128, 8
LAYOUT = "term string, range long, top int, ids array<long>, counts array<int>, places array<array<int>>"


def _postings(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Posting blocks of some texts (id, words), by range and term, from sorted codes and offsets."""
    lists = batch.column("words")
    sizes = pc.list_value_length(lists).to_numpy()
    words = lists.flatten().dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    ids = np.repeat(batch.column("id").to_numpy(), sizes)
    place = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.lexsort((place, ids, code, ids // width))
    ids, code, place, span = ids[order], code[order], place[order], ids[order] // width
    # where a new block begins, and where a new id within one
    block = np.append(True, (span[1:] != span[:-1]) | (code[1:] != code[:-1])) if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(block | np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ids))).astype(np.int32)
    held = np.flatnonzero(block[first])
    ends = pa.array(np.append(held, len(first)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(place))
    at = first[held]
    top = np.maximum.reduceat(counts, held) if len(held) else counts
    columns = [names.take(pa.array(code[at])), pa.array(span[at]), pa.array(top), pa.ListArray.from_arrays(ends, pa.array(ids[first])), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.ListArray.from_arrays(ends, places)]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", "top", "ids", "counts", "places"])


def build(texts: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """term, range, top, ids, counts, places: posting blocks of ``text`` by the whole number ``key``; rows without either are left out.

    ids and counts are in order; places are the words' numbers in the text, from 0.  The
    texts are shuffled once, by range, and no words: a task turns the texts of one range
    after another into blocks, and holds no more than WIDTH texts and a batch.
    """
    kept = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))
    dealt = kept.withColumn("_range", F.floor(F.col("id") / width)).repartition("_range").sortWithinPartitions("_range")
    rows = dealt.select("id", T.tokens(F.col("_text")).alias("words"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # of a range that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            span = batch.column("id").to_numpy() // width
            if left and left[-1].column("id")[0].as_py() // width != span[0]:
                yield _postings(pa.concat_batches(left), width)
                left = []
            last = int(np.searchsorted(span, span[-1]))
            if last:
                yield _postings(pa.concat_batches([*left, batch.slice(0, last)]), width)
                left = []
            left.append(batch.slice(last))
        if left:
            yield _postings(pa.concat_batches(left), width)

    return rows.mapInArrow(invert, LAYOUT)


def write(index: DataFrame, folder: str) -> DataFrame:
    """The index in files, each by term, read again.  Small row groups let a query skip what is not about its terms.

    Blocks stay where their range was dealt to, so each file has some blocks of every frequent term, and files are of like size.
    """
    index.sortWithinPartitions("term", "range").write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(folder)
    return index.sparkSession.read.schema(index.schema).parquet(folder)


def parse(query: str) -> list[tuple[list[tuple], list[tuple]]]:
    """A query as alternatives, each with the items that must be there and those that must not.

    Words side by side must all be there; ``OR`` (in capitals) divides alternatives; ``-``
    before an item excludes it; double quotes hold a phrase, as do words joined by other
    signs; a ``*`` behind a word stands for any ending.  An item is (words, prefix).
    An alternative without anything that must be there finds nothing and is left out.
    """
    out, must, never = [], {}, {}
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if bare == "OR" and not sign:
            out, must, never = [*out, (must, never)], {}, {}
            continue
        words = tuple(re.findall(r"\w+", (quoted or bare).lower()))
        if words:
            prefix = len(words) == 1 and bool(bare) and bare.endswith("*")
            (never if sign else must)[words, prefix] = None
    return [(list(m), list(n)) for m, n in [*out, (must, never)] if m]


def _queries(spark: SparkSession, queries: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Tables of what is asked for: the words of each item, and the alternatives of each query; terms and prefixes."""
    words, asked, terms, prefixes = [], [], set(), set()
    for q, query in enumerate(queries):
        items: dict[tuple, int] = {}
        clauses = []
        for must, never in parse(query):
            clauses.append(([items.setdefault(i, len(items)) for i in must], [items.setdefault(i, len(items)) for i in never]))
        wanted = sorted({i for m, _ in clauses for i in m})
        asked.append((q, query, clauses, wanted))
        for (found, prefix), item in items.items():
            (prefixes if prefix else terms).update(found)
            words += [(q, item, w, len(found), word, prefix) for w, word in enumerate(found)]
    return (
        spark.createDataFrame(words, "q int, item int, w int, words int, word string, prefix boolean"),
        spark.createDataFrame(asked, "q int, query string, clauses array<struct<must:array<int>,never:array<int>>>, wanted array<int>"),
        sorted(terms),
        sorted(prefixes),
    )


def _meet(index: DataFrame, words: DataFrame, terms: list[str], prefixes: list[str]) -> DataFrame:
    """Posting blocks of the words asked for; the terms are a filter that reaches the scan."""
    term = F.col("term")
    wanted = term.isin(terms)
    for p in prefixes:
        wanted = wanted | term.startswith(p)
    met = F.when(F.col("prefix"), F.startswith(term, F.col("word"))).otherwise(term == F.col("word"))
    exact = index.filter(wanted).join(F.broadcast(words.filter("not prefix")), term == F.col("word"))  # a row for each word of the queries
    if not prefixes:
        return exact
    return exact.unionByName(index.filter(wanted).join(F.broadcast(words.filter("prefix")), met))


def _holds(clauses: str, present: str, strict: bool) -> Column:
    """One of the alternatives has all its items, and (if strict) none that it excludes."""
    return F.exists(clauses, lambda c: (F.size(F.array_except(c["must"], F.col(present))) == 0) & (~F.arrays_overlap(c["never"], F.col(present)) if strict else F.lit(True)))


def bounds(index: DataFrame, words: DataFrame, asked: DataFrame, terms: list[str], prefixes: list[str]) -> DataFrame:
    """q, range, bound: ranges that can hold a hit, and the most that it can score."""
    met = _meet(index.select("term", "range", "top"), words, terms, prefixes)
    each = met.groupBy("q", "range", "item").agg(F.count_distinct("w").alias("n"), F.first("words").alias("words"), F.first("prefix").alias("prefix"), F.min("top").alias("least"), F.sum("top").alias("all"))
    item = F.when(F.col("prefix"), F.col("all")).otherwise(F.col("least"))
    each = each.filter("n = words").select("q", "range", "item", item.alias("most"))
    ranged = each.groupBy("q", "range").agg(F.collect_set("item").alias("present"), F.collect_list(F.struct("item", "most")).alias("b"))
    ranged = ranged.join(F.broadcast(asked), "q").filter(_holds("clauses", "present", False))
    positive = F.filter("b", lambda x: F.array_contains(F.col("wanted"), x["item"]))
    return ranged.select("q", "range", F.aggregate(positive, F.lit(0).cast("long"), lambda s, x: s + x["most"]).alias("bound"))


def _score(index: DataFrame, ranges: DataFrame, words: DataFrame, asked: DataFrame, terms: list[str], prefixes: list[str]) -> DataFrame:
    """q, id, score: the hits of some ranges of each query."""
    met = _meet(index, words, terms, prefixes).join(ranges.select("q", "range"), ["q", "range"], "left_semi")
    rows = met.select("q", "item", "w", "words", "prefix", F.explode(F.arrays_zip("ids", "counts", "places")).alias("x")).select("q", "item", "w", "words", "prefix", F.col("x.ids").alias("id"), F.col("x.counts").alias("n"), F.col("x.places").alias("places"))
    # where an item begins if the word stands there: a phrase is where all its words agree
    begins = F.when(F.col("words") > 1, F.transform("places", lambda p: p - F.col("w")))
    each = rows.groupBy("q", "id", "item").agg(F.first("words").alias("words"), F.sum("n").alias("n"), F.collect_list(F.struct("w", begins.alias("begins"))).alias("b"))
    agree = F.size(F.aggregate(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(0))), F.get("b", F.lit(0))["begins"], lambda s, x: F.array_intersect(s, x["begins"])))
    n = F.when(F.col("words") == 1, F.col("n")).when(F.size("b") == F.col("words"), agree.cast("long")).otherwise(0)
    each = each.select("q", "id", "item", n.alias("n")).filter("n > 0")
    hits = each.groupBy("q", "id").agg(F.collect_set("item").alias("present"), F.collect_list(F.struct("item", "n")).alias("b"))
    hits = hits.join(F.broadcast(asked), "q").filter(_holds("clauses", "present", True))
    positive = F.filter("b", lambda x: F.array_contains(F.col("wanted"), x["item"]))
    return hits.select("q", "id", F.aggregate(positive, F.lit(0).cast("long"), lambda s, x: s + x["n"]).cast("double").alias("score"))


def search(index: DataFrame, queries: Sequence[str], limit: int, first: int = FIRST, within: DataFrame | None = None, tie: Callable[[Column], Column] = lambda i: i) -> tuple[DataFrame, DataFrame]:
    """query, rank, id, score: the ``limit`` best of each query, equal scores by ``tie`` of the id; and q, query, ranges, read: how many ranges could hold a hit, and were read.

    Score: occurrences of the items that must be there, of any alternative that
    the text meets or not.  ``within`` (id) narrows the hits.  An empty query finds nothing.
    """
    spark = index.sparkSession
    given = _queries(spark, queries)
    asked = given[1]
    if not given[2] and not given[3]:
        none = asked.filter(F.lit(False))
        return none.select("query", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")), none.select("q", "query", F.lit(0).cast("long").alias("ranges"), F.lit(0).cast("long").alias("read"))
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
    ranges = bounds(index, *given)
    ranked = ranges.withColumn("nth", F.row_number().over(best))
    narrow = (lambda df: df) if within is None else (lambda df: df.join(within.select("id"), "id", "left_semi"))
    early = narrow(_score(index, ranked.filter(F.col("nth") <= first), *given))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), tie(F.col("id"))))
    early = early.withColumn("rank", nth).filter(F.col("rank") <= limit)
    # one row a query: what the k-th hit of the first ranges has
    reach = early.filter(F.col("rank") == limit).select("q", F.col("score").alias("reach"))
    open_ = ranked.filter(F.col("nth") > first).join(reach, "q", "left").filter(F.coalesce(F.col("bound") >= F.col("reach"), F.lit(True)))
    late = narrow(_score(index, open_, *given))
    hits = early.select("q", "id", "score").unionByName(late).withColumn("rank", nth).filter(F.col("rank") <= limit)
    out = hits.join(F.broadcast(asked.select("q", "query")), "q").select("query", "rank", "id", "score")
    read = ranked.join(reach, "q", "left").groupBy("q").agg(F.count("*").alias("ranges"), F.count_if((F.col("nth") <= first) | F.coalesce(F.col("bound") >= F.col("reach"), F.lit(True))).alias("read"))
    return out, asked.select("q", "query").join(read, "q", "left").select("q", "query", F.coalesce("ranges", F.lit(0)).alias("ranges"), F.coalesce("read", F.lit(0)).alias("read"))
