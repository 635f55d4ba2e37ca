"""Runs watched as a stream: a time budget, stalls of a counter, and the step to resume from.

``transformWithState`` keeps one small value a run and an event-time timer for whatever would happen next without
another row: the end of the budget, or the counter having stood still too long. A query that is stopped anywhere and
started again on its checkpoint gives the same rows as one that is not. (Time-to-live is for processing time alone;
a run whose budget is over keeps nothing but that.)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from criterium.sources.shared import exists, scratch

FOUND = "run bigint, kind string, at_us bigint, step bigint, resume_step bigint"
LANDED = "run bigint, at timestamp, counter string"

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else a store holds megabytes for files of bytes
}


class RunMonitor(StatefulProcessor):
    """``budget`` and ``stall`` in microseconds; a checkpoint every ``every`` steps."""

    def __init__(self, budget: int, stall: int, every: int):
        self.budget, self.stall, self.every = budget, stall, every

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first bigint, moved bigint, step bigint, stalled boolean, over boolean, counter string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.run.get() if self.run.exists() else None
        for at, counter in sorted((r.at_us, r.counter) for r in rows):
            if state is None:
                state = (at, at, 1, False, False, counter)
                continue
            state, found = self._until(state, at)
            for f in found:
                yield self._row(key, f)
            first, moved, step, stalled, over, had = state
            if over:
                break
            state = (first, moved, step + 1, stalled, over, had) if counter == had else (first, at, step + 1, False, over, counter)
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, found = self._until(self.run.get(), timerValues.getCurrentWatermarkInMs() * 1000)
        for f in found:
            yield self._row(key, f)
        self._keep(state)

    def close(self) -> None:
        pass

    def _until(self, state: tuple, now: int) -> tuple[tuple, list]:
        """What happens to a run up to ``now`` without a row of its own."""
        first, moved, step, stalled, over, counter = state
        found, end = [], first + self.budget
        if not over and not stalled and moved + self.stall < end and moved + self.stall <= now:
            found.append(("stall", moved + self.stall, step))
            stalled = True
        if not over and end <= now:
            found.append(("budget", end, step))
            over = True
        return (first, moved, step, stalled, over, counter), found

    def _row(self, key, found: tuple) -> Row:
        kind, at, step = found
        return Row(run=key[0], kind=kind, at_us=at, step=step, resume_step=step // self.every * self.every)

    def _keep(self, state: tuple) -> None:
        self.run.update(state)
        first, moved, _, stalled, over, _ = state
        ends = [] if over else [first + self.budget] + ([] if stalled else [moved + self.stall])
        due = {-(-min(ends) // 1000) + 1} if ends else set()  # whole milliseconds, none too early
        had = {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}
        for t in had - due:
            self.handle.deleteTimer(t)
        for t in due - had:
            self.handle.registerTimer(t)


def monitored(rows: DataFrame, budget: int, stall: int, every: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (run long, at timestamp, counter string), in order of time from one micro-batch to the next -> :data:`FOUND`."""
    keyed = rows.select("run", "at", F.unix_micros("at").alias("at_us"), "counter").withWatermark("at", late)
    return keyed.groupBy("run").transformWithState(RunMonitor(budget, stall, every), FOUND, "Append", "EventTime")


def take_in(spark: SparkSession, landed: str, out: str, checkpoint: str, budget: int, stall: int, every: int) -> None:
    """Bring what has landed through :func:`monitored` into ``out``, and stop."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(LANDED).parquet(landed)
        found = monitored(stream, budget, stall, every)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def in_slices(rows: DataFrame, slices: int, budget: int, stall: int, every: int) -> DataFrame:
    """A table (run, at, counter) through the stream, a slice of time after the other, the query started anew for each -> :data:`FOUND`."""
    spark = rows.sparkSession
    root = scratch(spark, "runs")
    first, last = rows.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    if first is None:
        return spark.createDataFrame([], FOUND)
    cut = F.floor((F.unix_micros("at") - F.lit(first)) * slices / (F.lit(last) - F.lit(first) + 1)).cast("int")
    rows.select(F.col("run").cast("long").alias("run"), "at", F.col("counter").cast("string").alias("counter"), cut.alias("slice")).where("run is not null and at is not null").write.partitionBy("slice").parquet(f"{root}/staged")
    for k in range(slices):
        if exists(spark, f"{root}/staged/slice={k}"):
            jvm = spark._jvm.org.apache.hadoop.fs
            files = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(jvm.Path(f"{root}/landed"))
            files.rename(jvm.Path(f"{root}/staged/slice={k}"), jvm.Path(f"{root}/landed/slice={k}"))
        take_in(spark, f"{root}/landed", f"{root}/found", f"{root}/checkpoint", budget, stall, every)
    return spark.read.schema(FOUND).parquet(f"{root}/found")
