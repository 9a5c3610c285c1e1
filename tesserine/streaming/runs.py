"""The life of runs as keyed state with event-time timers: routes of failures, idle runs, transitions that are not allowed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tesserine.operators.queueing import MAX_ATTEMPTS

#: Which status may follow which; a run that is not known (or forgotten) has none.
FOLLOWS = {"": ("queued", "running"), "queued": ("running", "failed"), "running": ("succeeded", "failed", "queued"), "failed": ("queued", "running"), "succeeded": (), "dead": ()}
#: Milliseconds: a running run without a message is idle, and attempts and finished runs are forgotten.
IDLE_MS, FORGET_MS = 60_000, 86_400_000
OUT = "run_id long, seq long, at timestamp, kind string, status string, attempts int"
STATE = "status string, attempts int, idle_at long, forget_at long"
#: The setting that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Life:
    """What one run is: status, attempts, and when it is idle and forgotten (0: never)."""

    def __init__(self, status: str = "", attempts: int = 0, idle_at: int = 0, forget_at: int = 0):
        self.status, self.attempts, self.idle_at, self.forget_at = status, attempts, idle_at, forget_at

    def due(self, now: int) -> Iterator[tuple]:
        """What happens by itself up to ``now``: (seq, at, kind, status, attempts)."""
        while times := [t for t in (self.idle_at, self.forget_at) if 0 < t <= now]:
            at = min(times)
            if at == self.forget_at:
                # attempts are counted for a day after the last one; a finished run is forgotten with them
                self.attempts, self.forget_at = 0, 0
                if self.status in ("succeeded", "dead"):
                    self.status, self.idle_at = "", 0
            else:
                yield None, at, *self._failed(at, "reclaim")

    def _failed(self, at: int, kind: str) -> tuple[str, str, int]:
        self.attempts, self.forget_at = self.attempts + 1, at + FORGET_MS
        if self.attempts >= MAX_ATTEMPTS:
            self.status, self.idle_at = "dead", 0
            return "dead", "dead", self.attempts
        self.idle_at = at + IDLE_MS if kind == "reclaim" else 0
        return kind, self.status, self.attempts

    def take(self, seq: int, at: int, status: str) -> Iterator[tuple]:
        yield from self.due(at)
        if status not in FOLLOWS[self.status]:
            yield seq, at, "illegal", status, self.attempts
            return
        self.status, self.idle_at = status, at + IDLE_MS if status == "running" else 0
        if status == "failed":
            yield seq, at, *self._failed(at, "retry")
        else:
            if status == "succeeded":
                self.forget_at = at + FORGET_MS
            yield seq, at, "status", status, self.attempts


class Runs(StatefulProcessor):
    """Keeps one ``Life`` for each run, and the two timers that it may have.

    A run's messages of one batch are put in order; what was due before a message is done before
    it, so the rows do not depend on where batches end.  The timers are for runs that
    hear nothing more.  State of a run that has neither status nor attempts is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mine = pd.concat([f[["seq", "ts", "status"]] for f in rows]).sort_values(["ts", "seq"])
        life = self._life()
        done = [row for seq, ts, status in mine.itertuples(index=False) for row in life.take(int(seq), ts.value // 1_000_000, status)]
        self._keep(life)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life = self._life()
        # all that is due by now, also what follows from the timer that went off
        done = list(life.due(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())))
        self._keep(life)
        yield self._rows(key, done)

    def close(self) -> None:
        pass

    def _life(self) -> Life:
        return Life(*self.state.get()) if self.state.exists() else Life()

    def _keep(self, life: Life) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        for at in {life.idle_at, life.forget_at} - {0}:
            self.handle.registerTimer(at)
        if life.status or life.attempts:
            self.state.update((life.status, life.attempts, life.idle_at, life.forget_at))
        else:
            self.state.clear()

    def _rows(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        seq, at, kind, status, attempts = zip(*done, strict=True) if done else ([],) * 5
        return pd.DataFrame({"run_id": pd.Series([key[0]] * len(done), dtype="int64"), "seq": pd.array(seq, dtype="Int64"), "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="ms"), "kind": pd.Series(kind, dtype="object"), "status": pd.Series(status, dtype="object"), "attempts": pd.Series(attempts, dtype="int32")})


def lives(messages: DataFrame, late: str = "1 minute") -> DataFrame:
    """run_id, seq, ts, status (a stream) -> run_id, seq, at, kind, status, attempts.

    kind: ``status`` (the run has it now), ``retry`` or ``dead`` (a failure, by its number),
    ``reclaim`` (idle for a minute: one more attempt; without a seq), ``illegal`` (a status that may
    not follow; nothing changes).  Rows with a null are left out, and so are those later than ``late``.
    """
    timed = messages.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "status").dropna().withWatermark("ts", late)
    # what comes after the watermark has passed its time is dropped, as with any event-time state
    schema = StructType.fromDDL(OUT)
    return timed.groupBy("run_id").transformWithStateInPandas(Runs(), schema, "Append", "EventTime")


def write_lives(rows: DataFrame, folder: str):
    """A running query: legal rows to ``folder``/events, the others to ``folder``/illegal, each batch to a folder of its own.

    A batch that is repeated after a failure overwrites what it has written.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, part in (("events", batch.filter("kind <> 'illegal'")), ("illegal", batch.filter("kind = 'illegal'"))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
