"""A batch service as a Spark data source: tasks submit and collect, rounds resume from what has been written.

Writing drafts one batch per ``size`` rows in the tasks and starts them when the write commits, so drafts of failed or
repeated tasks never run. Reading has a partition per started batch that is not closed: the task polls it to its end,
cancels it once if its counts stand still (:class:`StaleGuard`), and gives out its results; a repeated task reads
them again. :func:`run_rounds` keeps every answer in a table, so a run that is stopped anywhere goes on where it was.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from criterium.sources.shared import exists

FORMAT = "rubric_batches"
REQUEST = "custom_id string, attempt int, body string"
RESULT = "batch string, custom_id string, attempt int, outcome string, text string, stop_reason string"

#: Counters of a batch whose standing still shows that it is stuck. Fixed names.
COUNTS = ("processing", "succeeded", "errored", "canceled", "expired")


class BatchService:
    """What a service must offer. It is made in every task from the source's options, so it must keep nothing in memory."""

    def create(self, run: str, requests: list[dict]) -> str:
        """A draft of a batch; its id."""
        raise NotImplementedError

    def start(self, batch: str) -> None:
        raise NotImplementedError

    def cancel(self, batch: str) -> None:
        raise NotImplementedError

    def close(self, batch: str) -> None:
        """Its results have been kept."""
        raise NotImplementedError

    def open_batches(self, run: str) -> list[str]:
        """Started and not closed."""
        raise NotImplementedError

    def poll(self, batch: str) -> tuple[str, tuple[int, ...]]:
        """``in_progress`` or ``ended``, and its counts."""
        raise NotImplementedError

    def results(self, batch: str) -> Iterator[tuple[str, int, str, str | None, str | None]]:
        """custom_id, attempt, outcome, text, stop reason."""
        raise NotImplementedError


@dataclass
class StaleGuard:
    """Says once that a batch in progress should be cancelled: when its counts have not changed for ``after`` seconds (never, if None)."""

    after: float | None
    counts: tuple | None = None
    since: float = 0.0
    cancelled: bool = False

    def stale(self, status: str, counts: tuple, now: float) -> bool:
        if counts != self.counts:
            self.counts, self.since = counts, now
        if self.cancelled or self.after is None or status != "in_progress" or now - self.since < self.after:
            return False
        self.cancelled = True
        return True


def collected(service: BatchService, batch: str, pause: float, cancel_after: float | None, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple]:
    """Poll a batch to its end, then its results. A failed cancel is tried again at the next poll."""
    guard = StaleGuard(cancel_after)
    while True:
        status, counts = service.poll(batch)
        if status == "ended":
            break
        if guard.stale(status, counts, clock()):
            try:
                service.cancel(batch)
            except OSError:
                guard.cancelled = False
        time.sleep(pause)
    for result in service.results(batch):
        yield (batch, *result)


def _service(options: dict[str, str]) -> BatchService:
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class _Drafts(WriterCommitMessage):
    batches: list[str]


@dataclass
class _Open(InputPartition):
    batch: str


class BatchSource(DataSource):
    """Options: ``service`` (module:class), ``run``, ``size``, ``poll_seconds``, ``cancel_after_seconds``, and the service's own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(dict(self.options))


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Open(b) for b in _service(self.options).open_batches(self.options["run"])] or [_Open("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.batch:
            after = self.options.get("cancel_after_seconds")
            yield from collected(_service(self.options), partition.batch, float(self.options.get("poll_seconds", 30)), None if after is None else float(after))


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        service, size, drafts, rows = _service(self.options), int(self.options.get("size", 1000)), [], []
        for row in iterator:
            rows.append(row.asDict())
            if len(rows) == size:
                drafts.append(service.create(self.options["run"], rows))
                rows = []
        if rows:
            drafts.append(service.create(self.options["run"], rows))
        return _Drafts(drafts)

    def commit(self, messages: list) -> None:
        service = _service(self.options)
        for m in messages:
            for batch in m.batches:
                service.start(batch)

    def abort(self, messages: list) -> None:
        service = _service(self.options)
        for m in messages:
            for batch in m.batches if m else []:
                service.cancel(batch)


class FolderService(BatchService):
    """A stand-in that keeps batches in a folder (option ``folder``) and answers from a function (option ``answer``, module:function
    of custom_id and attempt -> outcome, text, stop reason). A batch is in progress for ``polls`` polls; answers ``stuck`` never end."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(options["folder"])
        self.fs, self.polls, self.seen = fs, int(options.get("polls", 1)), Counter()
        module, _, name = options["answer"].partition(":")
        self.answer, self.known = getattr(importlib.import_module(module), name), ("", [])

    def _put(self, name: str, text: str) -> None:
        self.files.create_dir(name.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(name) as f:
            f.write(text.encode())

    def _has(self, name: str) -> bool:
        return self.files.get_file_info(name).type == self.fs.FileType.File

    def create(self, run: str, requests: list[dict]) -> str:
        batch = f"{self.root}/{run}/{uuid.uuid4().hex}"
        self._put(f"{batch}/requests", json.dumps(requests))
        return batch

    def start(self, batch: str) -> None:
        self._put(f"{batch}/started", "")

    def cancel(self, batch: str) -> None:
        self._put(f"{batch}/cancelled", "")

    def close(self, batch: str) -> None:
        self._put(f"{batch}/closed", "")

    def open_batches(self, run: str) -> list[str]:
        found = self.files.get_file_info(self.fs.FileSelector(f"{self.root}/{run}", allow_not_found=True))
        return sorted(b.path for b in found if self._has(f"{b.path}/started") and not self._has(f"{b.path}/closed"))

    def _answers(self, batch: str) -> list[tuple]:
        """Those of the batch asked for last are kept: every poll and the results need them."""
        if self.known[0] != batch:
            with self.files.open_input_stream(f"{batch}/requests") as f:
                self.known = batch, [(r["custom_id"], r["attempt"], *self.answer(r["custom_id"], r["attempt"])) for r in json.loads(f.read())]
        return self.known[1]

    def poll(self, batch: str) -> tuple[str, tuple[int, ...]]:
        self.seen[batch] += 1
        outcomes = Counter(a[2] for a in self._answers(batch))
        done = self._has(f"{batch}/cancelled") or self.seen[batch] > self.polls and not outcomes["stuck"]
        left = 0 if done else outcomes["stuck"] or sum(outcomes.values())
        return "ended" if done else "in_progress", (left, *(outcomes[c] for c in COUNTS[1:]))

    def results(self, batch: str) -> Iterator[tuple]:
        for custom_id, attempt, outcome, text, stop in self._answers(batch):
            yield (custom_id, attempt, "canceled", None, None) if outcome == "stuck" else (custom_id, attempt, outcome, text, stop)


def _answers(spark: SparkSession, kept: str) -> DataFrame:
    return spark.read.schema(RESULT).parquet(kept) if exists(spark, kept) else spark.createDataFrame([], RESULT)


def collect(spark: SparkSession, kept: str, options: dict[str, str]) -> None:
    """Bring the results of all open batches into the table ``kept``, each batch once, then close them."""
    service = _service(options)
    open_now = service.open_batches(options["run"])
    if not open_now:
        return
    results = spark.read.format(FORMAT).options(**options).load()
    had = F.broadcast(_answers(spark, kept).select("batch").distinct().where(F.col("batch").isin(open_now)))
    results.join(had, "batch", "left_anti").write.mode("append").parquet(kept)
    for batch in open_now:
        service.close(batch)


def run_rounds(work: DataFrame, kept: str, options: dict[str, str], judged: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Submit what has no final answer, collect, and once more: custom_id, body -> custom_id, attempts, final columns.

    ``judged`` adds ``final`` (boolean: nothing more to ask), ``value`` and ``error`` to answers. Work that is final in no
    round keeps the error of its last answer. ``kept`` is the table of answers; a run that finds one resumes it.
    """
    spark = work.sparkSession
    spark.dataSource.register(BatchSource)
    for _ in range(rounds):
        collect(spark, kept, options)
        state = _state(_answers(spark, kept), judged)
        asked = F.coalesce("attempts", F.lit(0))
        todo = work.join(state, "custom_id", "left").where(~F.coalesce("final", F.lit(False)) & (asked < rounds))
        todo.select("custom_id", (asked + 1).cast("int").alias("attempt"), "body").write.format(FORMAT).options(**options).mode("append").save()
    collect(spark, kept, options)
    state = work.select("custom_id").join(_state(_answers(spark, kept), judged), "custom_id", "left")
    lost = F.coalesce("error", F.when(F.col("attempts").isNull(), "no result after all rounds"))
    return state.select("custom_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), "value", F.when(~F.coalesce("final", F.lit(False)), lost).otherwise(F.col("error")).alias("error"))


def _state(answers: DataFrame, judged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per work item: attempts so far, and its final answer, or else its last."""
    best = F.row_number().over(Window.partitionBy("custom_id").orderBy(F.desc("final"), F.desc("attempt"), "batch"))  # a row an attempt
    ranked = judged(answers).withColumn("_best", best).withColumn("attempts", F.count(F.lit(1)).over(Window.partitionBy("custom_id")).cast("int"))
    return ranked.where("_best = 1").select("custom_id", "attempts", "final", "value", "error")


def verdict_answers(answers: DataFrame, n_criteria: Column) -> DataFrame:
    """Judges' answers: a list of as many verdicts as there are criteria is final, and so is a refusal; all else may be asked again."""
    from criterium.functions.noisy import first_json_array

    answers = answers.withColumn("_found", F.from_json(first_json_array(F.col("text")), "array<string>"))
    found = F.col("_found")
    refused = (F.col("stop_reason") == "refusal") | (F.col("text") == "")
    error = (
        F.when(F.col("outcome") != "succeeded", F.concat(F.lit("judge_parse_error: batch result "), "outcome"))
        .when(refused, "judge_refusal")
        .when(F.col("stop_reason") == "max_tokens", "judge_truncated")
        .when(found.isNull(), "judge_parse_error: no list")
        .when(F.size(found) != n_criteria, "judge_parse_error: wrong number of verdicts")
    )
    rows = answers.withColumn("error", error)
    return rows.withColumn("final", F.col("error").isNull() | (F.col("error") == "judge_refusal")).withColumn("value", F.when(F.col("error").isNull(), F.array_join(found, ","))).drop("_found")
