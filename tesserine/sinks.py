"""Where results go: folders that all executors share, and pages by path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one for a session on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tesserine/{tag}-{uuid.uuid4().hex}"


#: Folders that this process has stored.
_STORED: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new shared folder that ``clear`` deletes."""
    _STORED.append(shared_dir(spark, tag))
    return _STORED[-1]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read again: what several results are taken from is computed once."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what was stored so far, and tells how many folders; to be called once the results that read them are written."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _STORED]
    _STORED.clear()
    return sum(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True) for at in paths)


def write_pages(pages: DataFrame, folder: str) -> None:
    """path, content_md as Parquet, laid out by the first folder of the path."""
    pages.withColumn("section", F.regexp_extract("path", "^/([^/]+)", 1)).write.partitionBy("section").mode("overwrite").parquet(folder)


def append(rows: DataFrame, folder: str) -> None:
    """Journal rows: runs, steps, revisions, activity."""
    rows.write.mode("append").parquet(folder)
