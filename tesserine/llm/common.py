"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder does for a session on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tesserine/{tag}-{uuid.uuid4().hex}"


#: Folders written inside the open ``clearing`` blocks, innermost last.
_WRITTEN: list[list[str]] = []


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.

    Inside a ``clearing`` block the folder is deleted at the end of the block,
    unless ``keep`` is set: then at the end of the block around that one.
    """
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    if len(_WRITTEN) > keep:
        _WRITTEN[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end; what is still to be read must be kept."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the key columns of ``left`` are kept once."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


#: Rows of one or two longs that a broadcast may hold: about 20 MB.
SMALL = 500_000


def small_or_shuffled(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of keys, which is broadcast only if it was counted to be small."""
    small = keys.count() <= SMALL
    return df.join(F.broadcast(keys) if small else keys, on, how)
