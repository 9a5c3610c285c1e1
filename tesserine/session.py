"""A session with the settings the library is tested with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tesserine", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Parts of a scan from which it is left as it is: what ``spread`` shuffles is never more than so many parts.
ENOUGH = 32


def spread(df: DataFrame) -> DataFrame:
    """A table as read, with fewer parts than cores, is dealt over all cores, for work that costs more than the shuffle of it.

    A small table is often one row group, and so one task.  A scan of ENOUGH parts
    (4 GB at the usual split size) or as many as cores is not shuffled.
    """
    cores = min(ENOUGH, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
