"""The ingest queue on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserine.operators.queueing import MAX_ATTEMPTS, TTL_S
from tesserine.sinks import shared_dir


def messages(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str, ttl_s: int = TTL_S) -> DataFrame:
    """Idempotent enqueue: later messages of a key within the time are dropped.

    The time is measured by the watermark, so a key can stay closed for longer
    than the batch operator would keep it.
    """
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", f"{ttl_s} seconds")
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at")


def routes(runs: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Every failure with its number and route; the state of a run is one number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])  # one run's messages of one micro-batch
        n = state.get[0] if state.exists else 0
        rows = rows[rows["status"] == "failed"]
        attempt = pd.RangeIndex(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        yield pd.DataFrame({"run_id": key[0], "seq": rows["seq"].to_numpy(), "attempt": attempt.to_numpy(), "route": ["retry" if a < limit else "dead" for a in attempt]})

    return runs.groupBy("run_id").applyInPandasWithState(step, "run_id long, seq long, attempt int, route string", "n int", "append", GroupStateTimeout.NoTimeout)


def activity_windows(stream: DataFrame, at: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and stop; the result is read from a table in the shared folder."""
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def ingest(stream: DataFrame, compile_batch: Callable[[DataFrame], dict[str, DataFrame]], folder: str) -> None:
    """Compile each micro-batch and write its tables under a folder of the batch: a repeated batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        for name, df in compile_batch(batch).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
