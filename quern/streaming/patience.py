"""Early stopping as state of a stream, by event time: steps are released in order behind the watermark, however they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quern.sources.shared import fresh

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGIN = (float("inf"), 0, False, 0)


def _on(state: tuple, steps: list[tuple], patience: int, delta: float) -> tuple:
    """best, steps without a better value, whether patience ran out, and the step at which it did, after ``steps`` (time, step, value) in order."""
    best, bad, out, stop = state
    for _, step, value in sorted(steps):
        if out:
            break
        if value < best - delta:
            best, bad = value, 0
        else:
            bad += 1
            out, stop = (True, step) if bad >= patience else (False, 0)
    return best, bad, out, stop


class Patience(StatefulProcessor):
    """A station's state: what has been released, and the steps that wait for the watermark, each with a timer of its time.

    What is reported after a batch is what the steps so far make in order, those that wait included: later batches correct it.
    """

    def __init__(self, patience: int, delta: float):
        self.patience, self.delta = patience, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "best double, bad long, out boolean, stop long")
        self.wait = handle.getListState("wait", "at long, step long, val double")

    def _state(self) -> tuple:
        return tuple(self.done.get()) if self.done.exists() else BEGIN

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        if not state[2]:
            for part in rows:
                for at, step, value in zip(part["at"].tolist(), part["step"].tolist(), part["val"].tolist(), strict=True):
                    self.wait.appendValue((at, step, value))
                    self.handle.registerTimer(at)
            state = _on(state, [tuple(w) for w in self.wait.get()], self.patience, self.delta)
        best, _, out, stop = state
        yield pd.DataFrame({"station": [key[0]], "best": [best], "stop": pd.array([stop if out else None], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(w) for w in self.wait.get()]
        due = [w for w in waiting if w[0] <= until]
        if due:
            state = _on(self._state(), due, self.patience, self.delta)
            self.done.update(state)
            rest = [] if state[2] else [w for w in waiting if w[0] > until]
            if rest:
                self.wait.put(rest)
            else:
                self.wait.clear()
        return iter(())

    def close(self) -> None:
        pass


def early_stops(steps: DataFrame, patience: int, delta: float, late: str) -> DataFrame:
    """station, best, stop from a stream of (station, ts, step, val): best value, and the step at which patience ran out. Lower is better.

    Steps are taken in order of time, then number, however they arrive within ``late`` of the newest; those that come later still are left out (the
    stream's progress counts them as dropped by the watermark). State holds a row a station and the steps of the last ``late``.
    """
    kind = steps.schema["station"].dataType.simpleString()
    rows = steps.withWatermark("ts", late).select("station", "ts", F.unix_millis("ts").alias("at"), F.col("step").cast("long"), F.col("val").cast("double"))
    return rows.groupBy("station").transformWithStateInPandas(
        Patience(patience, delta),
        f"station {kind}, best double, stop long",
        "Update",
        "EventTime",
    )


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """A store for several states a key, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def follow(steps: DataFrame, patience: int, delta: float, late: str, to: str) -> StreamingQuery:
    """One run over all steps there now, to its end; another run with the same ``to`` goes on from its state."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/rows/batch={number}")

    with _rocks(steps.sparkSession):
        writer = early_stops(steps, patience, delta, late).writeStream.outputMode("update").option("checkpointLocation", f"{to}/state")
        run = writer.foreachBatch(put).trigger(availableNow=True).start()
        run.awaitTermination()
    return run


def stopped(steps: DataFrame, patience: int, delta: float, late: str, to: str | None = None) -> DataFrame:
    """station, best, stop after one run over all steps there now."""
    spark = steps.sparkSession
    to = to or fresh(spark, "patience")
    follow(steps, patience, delta, late, to)
    latest = spark.read.parquet(f"{to}/rows").groupBy("station").agg(F.max_by(F.struct("best", "stop"), "batch").alias("last"))
    return latest.select("station", "last.*")
