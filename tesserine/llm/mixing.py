"""Operator 5, mixing sources to target weights: entropy balancing.

The mix gives each document a rate r >= 0, its expected number of copies.  Of
all rates whose words meet every source's target, entropy balancing takes those
nearest to the base rates q in token-weighted Kullback-Leibler divergence, with
r <= cap.  The convex dual has one multiplier per source and the solution is
the exponential tilt r = min(cap, q * exp(multiplier)).  Distributed Newton
steps from 0 find the multipliers: each step is one aggregation per source over the
words that share a base rate.  (The registered query gives every document the base
rate 1.)  Rates are then rounded to whole copies so that
each source's words stay near its target.  Only DataFrame functions are used.

Defined results: a null text has size 0; sources are ordered by code point,
null last, and a null source is a source of its own; documents of size 0 take
no words; an empty table gives an empty result; rows are dealt by source, size
and a hash of the id, so repeated rows are separate rows and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clearing, join_null_safe, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows of one source and size are dealt in groups of about this many.
DEAL = 256


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> and target: all words shared by weight, stopped at cap times the source's size.

    Sharing the excess again by weight until nobody is above is filling to a
    common level: with the sources in order of cap * size / weight, the level
    is that of the first source that the remaining words cannot fill.  The
    table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = (
        t.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("level", F.first(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return t.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def balance(moments: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9, most: int = 60) -> DataFrame:
    """The multiplier of each source.

    moments: source, base (rate q), words.  targets: source, target.  A Newton
    step on the dual is x - gap / slope with gap = sum(words * min(cap, q e^x)) -
    target and slope = the unclipped part of that sum; all start from 0, the base
    rates as they are, and steps are held to 2 so that none overshoots.  Where all
    rates are clipped, x goes down a little if too many words are taken, and stays if
    too few: more there are not.  Sums are decimals, which add up to the same value in
    any order.
    """
    with clearing(targets.sparkSession):
        state = materialise(targets.select("source", "target", F.when(F.col("target") > 0, 0.0).alias("x")), "newton")
        for _ in range(most):
            tilt = F.col("base") * F.exp("x")
            words = lambda v: F.sum(F.round(F.col("words") * v, 6).cast("decimal(38,6)")).cast("double")
            step = (
                join_null_safe(state, moments, ["source"])
                .groupBy("source", "target", "x")
                .agg(words(F.least(F.lit(float(cap)), tilt)).alias("now"), words(F.when(tilt < cap, tilt).otherwise(0.0)).alias("slope"))
                .withColumn("gap", F.col("now") - F.col("target"))
                .withColumn("move", F.when(F.col("slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("gap") / F.col("slope")))).otherwise(F.when(F.col("gap") > 0, 0.5).otherwise(0.0)))
                .withColumn("far", F.when(F.col("move") == 0, 0.0).otherwise(F.abs("gap") / F.col("target")))
                .select("source", "target", F.when(F.col("far") > tolerance, F.col("x") - F.col("move")).otherwise(F.col("x")).alias("x"), "far")
            )
            state = materialise(step.coalesce(1), "newton")  # one row per source
            if (state.agg(F.max("far")).first()[0] or 0.0) <= tolerance:
                break
        return materialise(state.select("source", "x"), "multipliers", keep=True)


def round_cells(cells: DataFrame, settle: int = 3) -> DataFrame:
    """source, size, n, part (0 <= part < 1: how many of the n rows get one more copy) -> and extra, a whole number.

    Within a source the sizes are taken from the largest to the smallest, and a cell
    gets what the rounded running sum of n * part grows by: the words are then wrong by
    no more than half the largest document.  What is missing, or too much, is then
    settled in the largest cell with room whose documents are no larger than that,
    ``settle`` times.  A window over a source holds one row for each distinct size
    and base rate.
    """
    by = Window.partitionBy("source")
    # exact decimals, narrow enough that sums and differences keep every place
    due = (F.col("n").cast("decimal(18,0)") * F.col("part").cast("decimal(10,9)")).cast("decimal(27,9)")
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))
    upto = F.sum(due).over(by.orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("decimal(28,9)")
    out = cells.withColumn("_due", due).withColumn("_upto", upto)
    out = out.withColumn("extra", (whole(F.col("_upto")) - whole(F.col("_upto") - F.col("_due"))).cast("long")).drop("_upto")
    for _ in range(settle):
        out = out.withColumn("_owed", F.sum((F.col("_due") - F.col("extra")) * F.col("size")).over(by))
        room = F.when(F.col("_owed") > 0, F.col("n") - F.col("extra")).otherwise(F.col("extra"))
        fits = (F.col("part") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("_owed")) & (room > 0)
        out = out.withColumn("_best", F.max(F.when(fits, F.struct("size", "part"))).over(by))
        change = F.least(room, F.floor(F.abs("_owed") / F.col("size"))).cast("long") * F.signum("_owed").cast("long")
        here = (F.col("size") == F.col("_best.size")) & (F.col("part") == F.col("_best.part"))
        out = out.withColumn("extra", F.col("extra") + F.when(here, change).otherwise(0)).drop("_owed", "_best")
    return out.drop("_due")


def mix(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, ``carry`` and, if there is one, base (rate, 1 where there is none) -> and source_size, target, copies, taken."""
    base = F.col("base").cast("double") if "base" in rows.columns else F.lit(1.0)
    rows = materialise(rows.select("doc_id", "source", F.col("size").cast("long").alias("size"), base.alias("base"), *carry), "sizes")
    cells = materialise(rows.groupBy("source", "size", "base").agg(F.count("*").alias("n")), "cells")
    moments = materialise(cells.groupBy("source", "base").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "moments")
    sizes = moments.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, cap), "targets")
    found = balance(moments, targets.select("source", "target"), cap)
    rate = F.coalesce(F.round(F.least(F.lit(float(cap)), F.col("base") * F.exp("x")), 9), F.lit(0.0))
    rated = join_null_safe(cells, found, ["source"]).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    rated = rated.select("source", "size", "base", "n", "whole", F.round(F.col("rate") - F.col("whole"), 9).alias("part"))
    plan = materialise(join_null_safe(round_cells(rated), targets, ["source"]).drop("part"), "plan")
    dealt = (
        join_null_safe(rows, plan, ["source", "size", "base"])
        .withColumn("h", F.xxhash64("doc_id"))
        .withColumn("groups", F.ceil(F.col("n") / DEAL))
        .withColumn("group", F.pmod("h", "groups"))
    )
    # each group gets its share of the extra copies by its number of rows, so none are lost
    cell = ["source", "size", "base"]
    shares = dealt.groupBy(*cell, "n", "extra", "group").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*cell).orderBy("group"))
    share = lambda k: F.expr(f"({k}) * extra div n")
    shares = shares.withColumn("upto", upto).select(*cell, "group", (share("upto") - share("upto - rows")).alias("quota"))
    dealt = join_null_safe(dealt, shares, [*cell, "group"])
    turn = F.row_number().over(Window.partitionBy(*cell, "group").orderBy("h", "doc_id", *carry))
    copies = F.col("whole") + F.when(turn <= F.col("quota"), 1).otherwise(0)
    return dealt.withColumn("copies", F.least(copies, F.lit(cap)).cast("long")).select("doc_id", "source", "size", *carry, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def document_sizes(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` as the mix has it: every row as often as it is taken, with unchanged columns."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sizes = document_sizes(numbered, "_row")
    taken = mix(sizes, weights, cap, ("_row",)).filter("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)


def op5_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(document_sizes(docs)).select("doc_id", "size", "source_size", "target", "taken", "copies")
