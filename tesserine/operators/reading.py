"""The agents' tools over tables of requests: lists by pattern, and pages, sections or whole documents by path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tesserine.functions import text as T
from tesserine.operators.compiling import split_lines

def rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


@F.pandas_udf(StringType())
def _regex(patterns: pd.Series) -> pd.Series:
    """Shell patterns as regular expressions: a row for each pattern, not for each document."""
    return patterns.map(T.glob_regex, na_action="ignore")


FIXED = "shape struct<least:int,head:int,tails:array<struct<back:int,size:int>>,inner:int>, key struct<head:string,tails:array<string>,inner:string>"


def matches(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id and the columns of the live documents whose path fits the pattern (pattern_id, pattern).

    Paths and patterns meet on what a pattern fixes (``text.glob_fixed``): what stands before
    its first wildcard, and behind its last ``*`` what is no wildcard, counted from the end.  A path
    comes once for each shape that patterns have (lengths and places of these pieces), and a
    pattern is tried only on the paths that have its pieces.
    """
    asked = patterns.select("pattern_id", rooted(F.col("pattern")).alias("_pattern")).dropna().withColumns({"_regex": _regex("_pattern"), "_fixed": F.udf(lambda p: T.glob_fixed(p), FIXED)("_pattern")})
    asked = asked.select("pattern_id", "_regex", F.col("_fixed.shape").alias("_shape"), F.col("_fixed.key").alias("_key"))
    live, n, shape = documents.filter(~F.col("archived")), F.length("path"), F.col("_shape")
    # as many rows as patterns have shapes, which are lengths within a path
    paths = live.select("path").distinct().join(F.broadcast(asked.select("_shape").distinct()), n >= shape["least"])
    tails = F.transform(shape["tails"], lambda t: F.substr("path", n - t["back"] + 1, t["size"]))
    pieces = F.transform(F.sequence(F.lit(1), n - shape["inner"] + 1), lambda i: F.substr("path", i, shape["inner"]))
    pieces = F.when(shape["inner"] == 0, F.array(F.lit(""))).otherwise(F.array_distinct(pieces))
    paths = paths.select("path", "_shape", F.left("path", shape["head"]).alias("_head"), tails.alias("_tails"), F.explode(pieces).alias("_inner"))
    paths = paths.select("path", "_shape", F.struct(F.col("_head").alias("head"), F.col("_tails").alias("tails"), F.col("_inner").alias("inner")).alias("_key"))
    met = paths.join(asked, ["_shape", "_key"]).filter(F.regexp_like("path", F.col("_regex")))
    return live.join(met.select("path", "pattern_id"), "path").select("pattern_id", *documents.columns)


def listed(documents: DataFrame, patterns: DataFrame, limit: int | None = 10, status: bool = True) -> DataFrame:
    """pattern_id, position, path, line: the first ``limit`` matches of each pattern by path, as the tool prints them."""
    nth = F.row_number().over(Window.partitionBy("pattern_id").orderBy("path"))
    rows = matches(documents, patterns).withColumn("position", nth)
    rows = rows if limit is None else rows.filter(F.col("position") <= limit)
    parts = [F.lit("- `"), F.col("path"), F.lit("` ["), F.col("kind"), F.lit("]")] + ([F.lit(" ("), F.col("status"), F.lit(")")] if status else [])
    return rows.select("pattern_id", "position", "path", F.concat(*parts).alias("line"))


def _joined(rows: DataFrame, key: str, order: str, text: str, mark: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(key).agg(F.array_join(ordered, mark).alias("text"))


def read(documents: DataFrame, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, text: what the read tool gives for each of requests (request_id, path, pages, sections).

    A path with ``*`` or ``?`` lists what it matches; with ``pages`` (as ``1-3, 7``) the pages
    of the document come each below its number; with ``sections`` (titles) only these; else
    all of it.  What is not found says so.  Nulls and empty texts ask for nothing.
    """
    asked = requests.select("request_id", F.col("path").alias("_asked"), rooted(F.col("path")).alias("path"), F.coalesce("pages", F.lit("")).alias("_pages"), "sections")
    wild = F.col("_asked").contains("*") | F.col("_asked").contains("?")
    lists = listed(documents, asked.filter(wild).select(F.col("request_id").alias("pattern_id"), F.col("path").alias("pattern")), None, False)
    lists = _joined(lists.withColumnRenamed("pattern_id", "request_id"), "request_id", "position", "line", "\n")
    none = F.concat(F.lit("No documents match `"), "_asked", F.lit("`."))
    lists = asked.filter(wild).join(lists, "request_id", "left").select("request_id", F.coalesce("text", none).alias("text"))

    found = asked.filter(~wild).join(documents.filter(~F.col("archived")).select("path", "doc_id", "content_md"), "path", "left")
    missing = found.filter("doc_id is null").select("request_id", F.concat(F.lit("Document `"), "_asked", F.lit("` not found.")).alias("text"))
    found = found.filter("doc_id is not null")
    by_page = found.filter("_pages <> ''")
    wanted = by_page.select("request_id", "doc_id", F.explode(T.page_range(F.col("_pages"))).alias("page_no"))
    chunks = wanted.join(pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("chunk")), ["doc_id", "page_no"])
    none = F.concat(F.lit("No pages found for `"), "_asked", F.lit("` and range `"), "_pages", F.lit("`."))
    by_page = by_page.join(_joined(chunks, "request_id", "page_no", "chunk", "\n\n"), "request_id", "left").select("request_id", F.coalesce("text", none).alias("text"))

    names = F.filter(F.transform(F.coalesce("sections", F.array().cast("array<string>")), lambda x: F.lower(T.trim(x))), lambda x: x != "")
    rest = found.filter("_pages = ''").withColumn("_names", names)
    whole = rest.filter(F.size("_names") == 0).select("request_id", F.coalesce("content_md", F.lit("")).alias("text"))
    parts = rest.filter(F.size("_names") > 0)
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = split_lines(parts.select("doc_id", "content_md").distinct()).withColumn("heading", F.col("line").startswith("#"))
    title = F.lower(T.trim(F.regexp_replace("line", "^#+", "")))
    lines = lines.withColumns({"title": F.last(F.when(F.col("heading"), title), ignorenulls=True).over(order), "nth": F.sum(F.col("heading").cast("int")).over(order)})
    chunk = _joined(lines.filter("title is not null").withColumn("_key", F.struct("doc_id", "nth", "title")), "_key", "pos", "line", "\n").select("_key.*", T.trim(F.col("text")).alias("chunk"))
    chosen = parts.select("request_id", "doc_id", F.explode(F.array_distinct("_names")).alias("title")).join(chunk, ["doc_id", "title"])
    parts = parts.join(_joined(chosen, "request_id", "nth", "chunk", "\n\n"), "request_id", "left").select("request_id", F.coalesce("text", F.lit("")).alias("text"))
    return lists.unionByName(missing).unionByName(by_page).unionByName(whole).unionByName(parts)


def budgeted(blocks: DataFrame, limit: int, mark: str = "\n\n[truncated]", joint: str = "\n\n") -> DataFrame:
    """doc_id, text: the blocks (doc_id, nth, text) of each document joined in order, cut at ``limit`` characters with ``mark`` behind.

    Running sums tell where a block begins; what begins behind the limit is not
    brought together, so a document's text is never longer than the limit in one row.
    """
    size = F.length("text") + len(joint)
    order = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("doc_id", "nth", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(order), F.lit(0)))
    total = rows.groupBy("doc_id").agg((F.sum(size) - len(joint)).alias("total"))
    kept = rows.filter(F.col("start") < limit + len(joint)).withColumn("text", F.left("text", F.greatest(F.lit(limit) - F.col("start"), F.lit(0)).cast("int")))
    text = _joined(kept, "doc_id", "nth", "text", joint)
    cut = F.when(F.col("total") > limit, F.concat(F.left("text", F.lit(limit)), F.lit(mark))).otherwise(F.col("text"))
    return text.join(total, "doc_id").select("doc_id", cut.alias("text"))
