"""Operator 8, sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets its global row number in key order; a keyed permutation of
[0, n) moves it to a new position, and that position alone gives shard
(position mod shards) and slot (position div shards).  So shard sizes differ by
one row at most, slots have no gaps, and where a row lies can be computed from
its number without looking at any other row (and back, with ``inverse=True``).
Only DataFrame functions are used.

Defined results: a null key sorts first; rows with equal keys are numbered by
their other columns, identical rows in any order (they are interchangeable); an
empty table gives an empty result; extra columns are left out, so clashing
names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

#: A prime below 2**31: products of two residues stay inside 64 bits.
PRIME = 2_147_483_647
#: Round keys are drawn from these fixed multipliers and offsets.
ROUNDS = ((1_103_515_245, 12_345), (69_069, 907_133_923), (1_664_525, 1_013_904_223), (22_695_477, 741_103_597))


def _step(df: DataFrame, mixed: str, changed: str, size: int, key: tuple[int, int], seed: int, sign: int) -> DataFrame:
    """changed += sign * f(mixed) mod size, with f a square between two affine maps modulo a prime.

    Each value that is used twice is a column of its own, so the plan stays linear in the rounds.
    """
    a, b = key
    df = df.withColumn("_z", (F.col(mixed) * a + (b + seed * 7_919) % PRIME) % PRIME)
    df = df.withColumn("_z", ((F.col("_z") * F.col("_z")) % PRIME * b + a) % PRIME % size)
    return df.withColumn(changed, F.pmod(F.col(changed) + sign * F.col("_z"), F.lit(size)))


def _once(df: DataFrame, x: str, rows: int, cols: int, seed: int, inverse: bool) -> DataFrame:
    """One pass of the alternating Feistel network over the grid rows x cols."""
    df = df.withColumn("_r", F.col(x) % cols).withColumn("_l", F.expr(f"({x} - _r) div {cols}"))
    steps = list(enumerate(ROUNDS))
    for i, key in reversed(steps) if inverse else steps:
        mixed, changed, size = ("_r", "_l", rows) if i % 2 == 0 else ("_l", "_r", cols)
        df = _step(df, mixed, changed, size, key, seed, -1 if inverse else 1)
    return df.withColumn(x, F.col("_l") * cols + F.col("_r")).drop("_l", "_r", "_z")


def grid(n: int) -> tuple[int, int]:
    """The smallest near-square grid with at least n cells; under sqrt(n) + 1 cells are left over."""
    rows = max(1, math.isqrt(max(0, n - 1)) + 1)
    return rows, max(1, -(-n // rows))


def permute(df: DataFrame, column: str, n: int, seed: int = 1, inverse: bool = False) -> DataFrame:
    """Replace ``column`` (0 <= value < n) by its image under the permutation.

    Cycle walking: a value that lands outside [0, n) is sent on until it is
    inside.  A walk passes only the under sqrt(n) + 1 left-over cells, so the
    number of passes it can need is found exactly, on a table of those cells.
    """
    rows, cols = grid(n)
    passes, rest, left = 1, df.sparkSession.range(n, rows * cols).select(F.col("id").alias("x")), rows * cols - n
    while left:
        rest = materialise(_once(rest, "x", rows, cols, seed, inverse).filter(F.col("x") >= n), "walk")
        still = rest.count()
        if still == left:  # only cycles that no row can reach are left
            break
        left, passes = still, passes + 1
    if left:
        passes += 1
    df = _once(df, column, rows, cols, seed, inverse)
    for _ in range(passes - 1):
        df = _once(df.withColumn("_was", F.col(column)), column, rows, cols, seed, inverse)
        df = df.withColumn(column, F.when(F.col("_was") < n, F.col("_was")).otherwise(F.col(column))).drop("_was")
    return df


def number_rows(df: DataFrame, keys: list[str], out: str = "row_no") -> tuple[DataFrame, int]:
    """Global row numbers 0.. in the order of ``keys``; returns the numbered table and its row count.

    A range-partitioned sort is written once to the shared folder with each
    row's place in its partition; the counts per partition (one small row each)
    give the offsets.  No window over all rows.
    """
    place = df.withColumn("_tie", F.monotonically_increasing_id()).sort(*[F.col(k).asc_nulls_first() for k in keys], "_tie").drop("_tie")
    place = materialise(place.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))), "starts")
    total = starts.agg(F.sum("_n")).first()[0] or 0
    # one row per sort partition: the table is as small as the list of tasks
    numbered = place.withColumn("_part", part).join(F.broadcast(starts.select("_part", "_start")), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start"), total


def shard(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 1) -> DataFrame:
    """``df`` with ``row_no``, ``shard`` (int) and ``slot`` (long)."""
    numbered, n = number_rows(df, keys)
    moved = permute(numbered.withColumn("_pos", F.col("row_no")), "_pos", n, seed)
    return moved.select(*numbered.columns, (F.col("_pos") % shards).cast("int").alias("shard"), F.expr(f"_pos div {shards}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null text: size 1, checksum of the empty text.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
