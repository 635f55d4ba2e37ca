"""Resumable work: only what has no output yet, as a batch or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without output: a left anti join, so a run may stop and start anywhere."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def run_once(stream: DataFrame, out: str, checkpoint: str, keys: list[str], at: str | None = None, late: str = "1 day") -> None:
    """Take what is there, drop repeats by key, append as Parquet, stop. With ``at``, state older than ``late`` is let go."""
    if at:
        rows = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    else:
        rows = stream.dropDuplicates(keys)
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def upsert_batches(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """Each micro-batch replaces nothing: it appends the rows whose keys are not in the output yet."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(out)
        fresh = batch.dropDuplicates(keys)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            fresh = pending(fresh, spark.read.parquet(out), keys)
        fresh.write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, every: str, late: str) -> DataFrame:
    """Counts and sums per tumbling window and type, with a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


class ProgressLog(StreamingQueryListener):
    """Keeps (batch, rows) of every progress report; the fan-out of sinks is Spark's listener bus."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
