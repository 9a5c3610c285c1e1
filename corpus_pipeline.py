"""The corpus pipeline: quality, near duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import decontaminate, jaccard, mixing, quality, sharding
from tesserine.llm.common import materialise, table
from tesserine.session import spread


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with unchanged columns.

    A null text is scored like an empty one; equal texts (repeated rows) stay or go together; a score
    of exactly the cut stays; without labels of both classes all stay; a row without an id
    is scored like others, but teaches nothing.
    """
    return quality.keep_good(spread(docs), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, null last.

    Rows are told apart by a number, so repeated rows and rows without an id are
    copies like others; a text without words is no copy.
    """
    docs = materialise(spread(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.similar_sets(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    found = materialise(found.join(docs.select("_row", "doc_id"), "_row"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = found.groupBy("component_id").agg(first.alias("first")).select("first._row")
    gone = materialise(found.select("_row").join(kept, "_row", "left_anti"), "gone")
    return docs.join(gone, "_row", "left_anti").drop("_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, with unchanged columns.

    Null, empty and blank texts stay; equal texts stay or go together, whatever their
    ids; null and empty items match nothing.
    """
    return decontaminate.keep_clean(spread(docs), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three equal rows, or none.

    A null source is a source of its own, the last; null and blank texts have the size 0 and
    take no words; repeated rows are documents of their own; reruns agree.
    """
    return mixing.mix_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document.

    Rows of equal id and text, as the mix makes them, have places of their own; a null text has the
    size 1 and the checksum of an empty one.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next.

    Nulls, repeated rows, empty tables and further columns go through as the stages say; an empty table
    gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
