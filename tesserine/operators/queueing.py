"""The run queue as batch operators: idempotent enqueue, retries, dead letters, final states, metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_S, MAX_ATTEMPTS = 3600, 3


def accepted(messages: DataFrame, keys: Sequence[str], at: str, ttl_s: int = TTL_S) -> DataFrame:
    """Messages that an idempotent enqueue accepts: the first of a key, then the first one ``ttl_s`` after the last accepted.

    A fold along each key's times: rows come sorted and one time is held, so a
    key of any size needs no memory.
    """
    keys = list(keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, None
        for f in frames:
            keep = []
            for key, t in zip(f[keys].itertuples(index=False, name=None), f[at], strict=True):
                fresh = key != held or (t - last).total_seconds() >= ttl_s
                if fresh:
                    held, last = key, t
                keep.append(fresh)
            yield f[keep]

    return messages.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(fold, messages.schema)


def attempts(runs: DataFrame) -> DataFrame:
    """Every failure with its number and where it goes: requeued below MAX_ATTEMPTS, else dead; failures after that stay dead."""
    order = Window.partitionBy("run_id").orderBy("ts", "seq")
    failed = runs.filter("status = 'failed'").withColumn("attempt", F.row_number().over(order))
    return failed.select("run_id", "seq", "attempt", F.when(F.col("attempt") < MAX_ATTEMPTS, "retry").otherwise("dead").alias("route"))


def dead_letters(runs: DataFrame) -> DataFrame:
    """Runs that went to the dead letters: when, and after which message."""
    return attempts(runs).filter(F.col("attempt") == MAX_ATTEMPTS).select("run_id", "seq")


def replay(runs: DataFrame, letters: DataFrame) -> DataFrame:
    """Messages that put dead runs back into the queue with attempts at zero."""
    return runs.join(letters.select("run_id", "seq"), ["run_id", "seq"], "left_semi").withColumn("status", F.lit("queued"))


def final_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("steps"))


def idle(runs: DataFrame, as_of: str, idle_s: int = 60) -> DataFrame:
    """Runs still running whose last message is at least ``idle_s`` old."""
    last = runs.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))
    return last.filter((F.col("status") == "running") & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) >= idle_s)).select("run_id", "ts")


def histogram(df: DataFrame, label: str, value: str, buckets: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts: label, le, n."""
    counts = df.groupBy(label).agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(buckets)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(buckets)])
    return counts.select(label, F.inline(rows))


def bucket_quantile(df: DataFrame, label: str, value: str, buckets: Sequence[float], q: float) -> DataFrame:
    """A quantile from fixed buckets, straight inside the bucket where it falls; the last bound for values beyond all.

    label, quantile, n.  Only the counts of the buckets are held.
    """
    total = F.count("*").alias("n")
    at = df.groupBy(label).agg(total, *[F.count_if(F.col(value) <= b).cast("double").alias(f"b{i}") for i, b in enumerate(buckets)])
    want, out = F.col("n") * F.lit(q), F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low, below = (F.lit(float(buckets[i - 1])), F.col(f"b{i - 1}")) if i else (F.lit(0.0), F.lit(0.0))
        inside = low + (F.lit(float(buckets[i])) - low) * (want - below) / F.nullif(F.col(f"b{i}") - below, F.lit(0.0))
        out = F.when(F.col(f"b{i}") >= want, inside).otherwise(out)
    return at.select(label, F.round(out, 6).alias("quantile"), "n")


def rates(df: DataFrame, at: str, keys: Sequence[str], seconds: int) -> DataFrame:
    """keys, start, n, per_second: how many in each window of time."""
    start = F.window(F.col(at), f"{seconds} seconds")["start"]
    counted = df.groupBy(*keys, start.alias("start")).agg(F.count("*").alias("n"))
    return counted.withColumn("per_second", F.round(F.col("n") / float(seconds), 6))


#: A quantile from sketches is off by no more than this share of it.
ERROR = 0.01


def sketches(df: DataFrame, at: str, keys: Sequence[str], value: str, seconds: int = 60, error: float = ERROR) -> DataFrame:
    """keys, start, bucket, n: how many values of each piece of time lie in each bucket.

    Buckets grow by the factor (1 + error) / (1 - error), so the middle of one is no further than
    ``error`` from any of its values, whatever they are.  Counts of buckets add up: sketches of pieces, of
    keys or of several runs are merged by a sum.  A bucket is a whole number whose sign is that of the values; that of
    zero is null.  Null values and times are left out.
    """
    factor = math.log((1 + error) / (1 - error))
    v = F.col(value)
    # counted from far below so that positive numbers have positive buckets
    nth = (F.ceil(F.log(F.abs(v)) / factor) + SHIFT).cast("long")
    bucket = F.when(v > 0, nth).when(v < 0, -nth)
    start = F.window(F.col(at), f"{seconds} seconds")["start"]
    return df.filter(v.isNotNull() & F.col(at).isNotNull()).groupBy(*keys, start.alias("start"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


#: Larger than the number of any bucket: doubles reach to about e to the 745, down and up.
SHIFT = 1_000_000_000


def sliding_quantile(pieces: DataFrame, keys: Sequence[str], seconds: int, step: int, q: float, error: float = ERROR) -> DataFrame:
    """keys, start, n, quantile of each window of ``seconds`` that begins every ``step`` seconds, from the sketches of its pieces.

    The value at rank ceil(q n), to ``error`` of itself.  The pieces must not be longer
    than ``step`` and divide it.  What is put in one task are the buckets of one window.
    """
    factor = math.log((1 + error) / (1 - error))
    start = F.window(F.col("start"), f"{seconds} seconds", f"{step} seconds")["start"]
    merged = pieces.groupBy(*keys, start.alias("start"), "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "start").orderBy(F.coalesce("bucket", F.lit(0)))
    ranked = merged.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy(*keys, "start"))})
    at = ranked.filter((F.col("_upto") >= F.ceil(F.lit(q) * F.col("_all"))) & (F.col("_upto") - F.col("n") < F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_all")))))
    low = F.exp((F.abs("bucket") - SHIFT - 1) * factor)
    middle = low * (1 + error)
    return at.select(*keys, "start", F.col("_all").alias("n"), F.coalesce(F.signum("bucket") * middle, F.lit(0.0)).alias("quantile"))


def sliding_rates(df: DataFrame, at: str, keys: Sequence[str], seconds: int, step: int) -> DataFrame:
    """keys, start, n, per_second for windows of ``seconds`` that begin every ``step`` seconds: counts of steps first, so each row is counted once."""
    piece = F.window(F.col(at), f"{step} seconds")["start"]
    counted = df.groupBy(*keys, piece.alias("start")).agg(F.count("*").alias("n"))
    start = F.window(F.col("start"), f"{seconds} seconds", f"{step} seconds")["start"]
    return counted.groupBy(*keys, start.alias("start")).agg(F.sum("n").alias("n")).withColumn("per_second", F.round(F.col("n") / float(seconds), 6))


def increases(df: DataFrame, at: str, keys: Sequence[str], value: str, seconds: int, step: int) -> DataFrame:
    """keys, start, increase: how much a counter has grown in each window; one that falls has begun again from zero.

    Readings are in the order of ``at`` and value.  The first reading of a series adds nothing.
    """
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at, value))
    grown = df.withColumn("_by", F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)).otherwise(F.lit(0)))
    piece = F.window(F.col(at), f"{step} seconds")["start"]
    counted = grown.groupBy(*keys, piece.alias("start")).agg(F.sum("_by").alias("increase"))
    start = F.window(F.col("start"), f"{seconds} seconds", f"{step} seconds")["start"]
    return counted.groupBy(*keys, start.alias("start")).agg(F.sum("increase").alias("increase"))


def _last(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"), F.count_if(F.col("status") == "failed").alias("failures"))


def depths(runs: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """One row: runs that wait or run, and runs among the dead letters."""
    return _last(runs).agg(F.count_if(F.col("status").isin("queued", "running")).alias("waiting"), F.count_if(F.col("failures") >= limit).alias("dead"))


def reclaim(runs: DataFrame, as_of: str, idle_s: int = 60, batch: int = 10, limit: int = MAX_ATTEMPTS, locked: DataFrame | None = None) -> DataFrame:
    """The longest idle runs, ``batch`` of them, without those of ``locked``: one more attempt, or to the dead letters at ``limit``."""
    rows = _last(runs).filter((F.col("status") == "running") & (F.col("ts").cast("timestamp_ntz") <= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(idle_s))))
    if locked is not None:
        rows = rows.join(locked.select("run_id"), "run_id", "left_anti")
    rows = rows.orderBy("ts", "run_id").limit(batch).withColumn("attempts", F.col("failures") + 1)
    return rows.select("run_id", "ts", "attempts", F.when(F.col("attempts") >= limit, "dead").otherwise("retry").alias("route"))
