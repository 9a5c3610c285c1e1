"""Running counts along a key of any size: a window over bounded parts, and one over the parts' totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of the order to one part: a key has at most so many rows in one part.
WIDTH = 20_000


def running(df: DataFrame, keys: Sequence[str], order: str, counts: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``df`` with a column for each of ``counts``: how many rows of the key up to and with this one have the flag, or the sum of a number.

    ``order`` is a whole number that a key has once, so a part (``width`` numbers of
    it) holds at most ``width`` rows of a key.  A hot key is many parts in many
    tasks; what is put in one task are its parts' totals, one row for ``width`` rows.
    """
    part = F.floor(F.col(order) / width).alias("_part")
    flags = {f"_is_{name}": F.coalesce(flag.cast("long"), F.lit(0)) for name, flag in counts.items()}
    rows = df.withColumns(flags).withColumn("_part", part)
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in flags])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_before"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_sum{c}") for c in flags])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part").eqNullSafe(F.col("_before"))]
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, on).withColumns({name: F.col(f"_sum_is_{name}") + F.sum(f"_is_{name}").over(inside) for name in counts})
    return out.select(*df.columns, *counts)


def following(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the next larger ``order`` of the key as ``name``, null at the last; dealt as in ``running``."""
    rows = df.withColumn("_part", F.floor(F.col(order) / width))
    firsts = rows.groupBy(*keys, "_part").agg(F.min(order).alias("_first"))
    later = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_before"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part")).alias("_next"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part").eqNullSafe(F.col("_before"))]
    inside = F.lead(order).over(Window.partitionBy(*keys, "_part").orderBy(order))
    return rows.join(later, on).select(*df.columns, F.coalesce(inside, "_next").alias(name))
