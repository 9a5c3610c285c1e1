"""Connected components of a link table, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clearing, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, comp (the smallest id reachable by links) for every id that has a link.

    Each round a node takes the smallest label among itself and its neighbours
    and then the label of that label (pointer jumping), so the rounds grow with
    the logarithm of a component's diameter.  All groupings are minima, which
    combine before the shuffle; a node with very many links is split by the
    adaptive skew join.  Labels are written to the shared folder every round.
    """
    with clearing(links.sparkSession):
        one, two = F.col(a), F.col(b)
        pairs = links.select(one.alias("u"), two.alias("v")).filter("u <> v")
        both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
        labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("comp")).withColumnRenamed("u", "id"), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("comp").alias("near")).withColumnRenamed("u", "id")
            met = labels.join(near, "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("c"))
            hooked = met.groupBy("was").agg(F.min("c").alias("up")).withColumnRenamed("was", "c")
            jumped = materialise(
                met.join(hooked, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("comp")),
                "labels",
            )
            moved = jumped.filter("comp <> was").limit(1).count()
            labels = jumped.select("id", "comp")
            if not moved:
                return materialise(labels, "components", keep=True)
