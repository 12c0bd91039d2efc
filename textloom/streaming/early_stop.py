"""Best score so far and early stop of each run, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State stores that hold timers and typed state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "run_id string, step long, score double, event string"


class EarlyStop(StatefulProcessor):
    """Rows (run_id, step, score, ts) -> what happens to each run.

    `best`: a score above all before. `stopped`: `patience` evaluations in a row
    brought none; later ones are passed over. `expired`: nothing came for `idle_ms`
    of event time; the run's state is dropped, and if it goes on it starts anew.
    Evaluations of one batch are taken by step, then score, whatever order they
    arrive in, so a batch that is run again says the same. Null scores count as no
    improvement.
    """

    def __init__(self, patience: int, idle_ms: int) -> None:
        self.patience, self.idle_ms = patience, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "best double, step long, waited int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (run,) = key
        best, at, waited, stopped = self.state.get() if self.state.exists() else (None, None, 0, False)
        last = 0
        for r in sorted(rows, key=lambda r: (r["step"], r["score"] is not None, r["score"] or 0.0)):
            last = max(last, r["millis"])
            if stopped:
                continue
            if r["score"] is not None and (best is None or r["score"] > best):
                best, at, waited = r["score"], r["step"], 0
                yield Row(run_id=run, step=at, score=best, event="best")
            else:
                waited += 1
                if waited >= self.patience:
                    stopped = True
                    yield Row(run_id=run, step=r["step"], score=best, event="stopped")
        self.state.update((best, at, waited, stopped))
        for due in list(self.handle.listTimers()):
            last = max(last, due - self.idle_ms)
            self.handle.deleteTimer(due)
        self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            best, at, _, _ = self.state.get()
            self.state.clear()
            yield Row(run_id=key[0], step=at, score=best, event="expired")

    def close(self) -> None:
        pass


def early_stop(evaluations: DataFrame, patience: int = 3, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each run (columns OUTPUT) from a stream of evaluations (run_id, step, score, ts); `late` is the watermark's delay.

    The session has to keep state in PROVIDER (spark.sql.streaming.stateStore.providerClass).
    State is one small row for each run that hasn't been idle.
    """
    spark = evaluations.sparkSession
    idle_ms = _millis(spark, idle)
    rows = evaluations.withWatermark("ts", late).withColumn("millis", F.unix_millis("ts"))
    return rows.groupBy("run_id").transformWithState(EarlyStop(patience, idle_ms), OUTPUT, "append", "eventTime")


def _millis(spark, length: str) -> int:
    return spark.sql(f"SELECT unix_millis(TIMESTAMP '2000-01-01' + INTERVAL {length}) - unix_millis(TIMESTAMP '2000-01-01')").first()[0]


def run_early_stop(evaluations: DataFrame, path: str, checkpoint: str, **settings) -> StreamingQuery:
    """Appends events to a Parquet folder, whose log of batches keeps each once; started again it goes on where it was."""
    return early_stop(evaluations, **settings).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
