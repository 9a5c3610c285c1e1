"""Keyed state of runs: against the plain life of each run, over restarts, and in size."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tesserine.streaming import runs

SCHEMA = "run_id long, seq long, ts timestamp, status string"
DAY = 86_400


@pytest.fixture
def stateful(spark):
    spark.conf.set(*runs.PROVIDER)
    yield spark
    spark.conf.unset(runs.PROVIDER[0])


def batches(spark, folder, rows):
    """One file a batch: run_id, seq, second, status."""
    for i, batch in enumerate(rows):
        df = spark.createDataFrame(batch, "run_id long, seq long, s long, status string").select("run_id", "seq", F.timestamp_seconds("s").alias("ts"), "status")
        df.coalesce(1).write.parquet(f"{folder}/{i:04d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def read(spark, folder):
    found = []
    for name in ("events", "illegal"):
        found += [(r["run_id"], r["seq"], int(r["at"].replace(tzinfo=timezone.utc).timestamp()) if isinstance(r["at"], datetime) else r["at"], r["kind"], r["status"], r["attempts"]) for r in spark.read.schema(runs.OUT).parquet(f"{folder}/{name}/*").collect()]
    return sorted(found, key=repr)


def plain(rows, until):
    """Every run by itself, and what its timers do up to the last watermark."""
    out, lives = [], {}
    for run, seq, s, status in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        life = lives.setdefault(run, runs.Life())
        out += [(run, q, at // 1000, kind, st, n) for q, at, kind, st, n in life.take(seq, s * 1000, status)]
    for run, life in lives.items():
        out += [(run, q, at // 1000, kind, st, n) for q, at, kind, st, n in life.due(until * 1000)]
    return sorted(out, key=repr)


def test_a_life_by_hand():
    life = runs.Life()
    said = [x[2:] for s, status in ((0, "queued"), (1, "running"), (2, "failed"), (3, "running"), (4, "succeeded"), (5, "running")) for x in life.take(s, s * 1000, status)]
    assert said == [("status", "queued", 0), ("status", "running", 0), ("retry", "failed", 1), ("status", "running", 1), ("status", "succeeded", 1), ("illegal", "running", 1)]
    life = runs.Life()
    list(life.take(0, 1000, "running"))
    assert [(x[1], x[2], x[4]) for x in life.due(10**9)] == [(61_000, "reclaim", 1), (121_000, "reclaim", 2), (181_000, "dead", 3)] and life.status == ""
    life = runs.Life()
    said = [x[2] for s, status in ((0, "running"), (1, "failed"), (2, "running"), (3, "failed"), (4, "queued"), (4 + DAY, "running"), (5 + DAY, "failed")) for x in life.take(s, s * 1000, status)]
    assert said == ["status", "retry", "status", "retry", "status", "status", "retry"]  # the third failure counts as a first


def test_rows_over_batches_and_restarts(stateful, tmp_path):
    """The same rows in one go, and with a sink that fails at two batches and is started again."""
    spark, r = stateful, random.Random(1)
    rows, now = [], 1_700_000_000
    for b in range(5):
        batch = []
        for i in range(40):
            now += r.choice([1, 5, 30, 400])
            batch.append((r.randrange(12), b * 100 + i, now, r.choice(["queued", "running", "running", "failed", "succeeded"])))
        rows.append(batch)
    rows.append([(99, 999, now + 3 * DAY, "queued")])
    stream = batches(spark, tmp_path / "in", rows)
    want = plain([x for b in rows for x in b], now + 3 * DAY - 60)
    runs.write_lives(runs.lives(stream), str(tmp_path / "whole")).awaitTermination()
    assert read(spark, tmp_path / "whole") == want
    assert {x[3] for x in want} == {"status", "retry", "dead", "reclaim", "illegal"}

    failing = {1, 3}
    out = str(tmp_path / "broken")

    def broken(batch, number):
        part = batch.filter("kind <> 'illegal'")
        part.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        if number in failing:
            failing.discard(number)
            raise RuntimeError("lost")
        batch.filter("kind = 'illegal'").write.mode("overwrite").parquet(f"{out}/illegal/batch={number}")

    for _ in range(3):
        query = runs.lives(stream).writeStream.foreachBatch(broken).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            continue
    assert not failing and read(spark, tmp_path / "broken") == want


def test_state_does_not_grow(stateful, tmp_path):
    """Two hundred new runs a day; each is finished, and forgotten a day later."""
    rows = [[(b * 1000 + i, b, 1_700_000_000 + b * 2 * DAY + i, s) for i in range(100) for s in ("queued", "running")][::2] + [(b * 1000 + i, b + 100, 1_700_000_000 + b * 2 * DAY + i + 1, "running") for i in range(100)] + [(b * 1000 + i, b + 200, 1_700_000_000 + b * 2 * DAY + i + 2, "succeeded") for i in range(100)] for b in range(5)]
    query = runs.write_lives(runs.lives(batches(stateful, tmp_path / "in", rows)), str(tmp_path / "out"))
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 2.5 * 200 and len(read(stateful, tmp_path / "out")) == 1500


def test_query_gives_the_lives_of_all_runs(stateful):
    from tesserine.plans import catalogue
    from tesserine.tables import read as table

    d = "/root/testdata/sf0.01"
    kinds = {"error": "failed", "purchase": "succeeded", "signup": "queued"}
    rows = [(r["user_id"], r["event_id"], r["s"], kinds.get(r["event_type"], "running")) for r in table(stateful, d, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "event_type").collect()]
    got = sorted(((r["run_id"], r["seq"], r["s"], r["kind"], r["status"], r["attempts"]) for r in catalogue.stream_run_lives(stateful, d).withColumn("s", F.unix_timestamp("at")).collect()), key=repr)
    assert got == plain(rows, max(r[2] for r in rows) - 60)
