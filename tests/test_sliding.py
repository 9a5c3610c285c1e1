"""Rates, sketches and increases over sliding windows against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesserine.operators import queueing


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).repartition(3)


def windows(rows, seconds, step):
    out = {}
    for k, s, v in rows:
        first = (s // step) * step
        for i in range(seconds // step):
            out.setdefault((k, first - i * step), []).append((s, v))
    return out


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_are_within_the_error(spark, q):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randrange(0, 3600), r.choice([r.lognormvariate(0, 4), -r.lognormvariate(0, 3), 0.0, 1e300, -1e-300])) for _ in range(800)]
    got = queueing.sliding_quantile(queueing.sketches(frame(spark, [*rows, ("a", 5, None)]), "ts", ["k"], "v", 60), ["k"], 600, 120, q)
    want = windows(rows, 600, 120)
    found = {(x["k"], x["s"]): (x["n"], x["quantile"]) for x in got.withColumn("s", F.unix_timestamp("start")).collect()}
    assert set(found) == set(want)
    for key, values in want.items():
        exact = sorted(v for _, v in values)[max(1, math.ceil(q * len(values))) - 1]
        assert found[key][0] == len(values) and abs(found[key][1] - exact) <= queueing.ERROR * abs(exact) * (1 + 1e-6)


def test_sketches_of_parts_add_up(spark):
    rows = [("a", i, float(i)) for i in range(300)]
    one = queueing.sketches(frame(spark, rows), "ts", ["k"], "v")
    two = queueing.sketches(frame(spark, rows[::2]), "ts", ["k"], "v").unionByName(queueing.sketches(frame(spark, rows[1::2]), "ts", ["k"], "v"))
    merged = two.groupBy("k", "start", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, one.collect())) == sorted(map(str, merged.collect()))


def test_rates_and_increases(spark):
    r = random.Random(6)
    rows, level = [], 0.0
    for s in range(0, 4000, 7):
        level = 0.0 if r.random() < 0.05 else level + r.randrange(5)
        rows.append(("a", s, level))
    df = frame(spark, rows)
    rates = {x["s"]: x["n"] for x in queueing.sliding_rates(df, "ts", ["k"], 300, 60).withColumn("s", F.unix_timestamp("start")).collect()}
    assert rates == {k[1]: len(v) for k, v in windows(rows, 300, 60).items()}
    grown = [("a", s, 0.0 if i == 0 else v - rows[i - 1][2] if v >= rows[i - 1][2] else v) for i, (_, s, v) in enumerate(rows)]
    found = {x["s"]: x["increase"] for x in queueing.increases(df, "ts", ["k"], "v", 300, 60).withColumn("s", F.unix_timestamp("start")).collect()}
    assert found == {k[1]: sum(v for _, v in x) for k, x in windows(grown, 300, 60).items()}
