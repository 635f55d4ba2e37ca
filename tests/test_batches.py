"""Rounds over a batch service: all work ends, once, also after runs that were stopped."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from criterium.sources import batches
from criterium.sources.shared import scratch

ASKED = Counter()


def answer(custom_id, attempt):
    n = int(custom_id)
    if n % 5 == 0 and attempt == 1:
        return "errored", None, None
    if n % 7 == 0:
        return "succeeded", "", "refusal"
    if n % 11 == 0:
        return "expired", None, None
    return "succeeded", f"fine: [{n}]", "end_turn"


def stuck(custom_id, attempt):
    return ("stuck", None, None) if int(custom_id) % 4 == 0 and attempt == 1 else ("succeeded", "[1]", "end_turn")


def judged(answers):
    return batches.verdict_answers(answers, F.lit(1))


@pytest.fixture
def options(spark):
    return {"service": "criterium.sources.batches:FolderService", "answer": "tests.test_batches:answer", "folder": scratch(spark, "batches"), "run": "r", "poll_seconds": "0", "size": "7"}


def work(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("custom_id"), F.lit("{}").alias("body")).repartition(3)


def want(n):
    out = {}
    for i in range(n):
        first, second = answer(str(i), 1), answer(str(i), 2)
        final = lambda a: a[0] == "succeeded"
        last = first if final(first) else second
        error = "judge_refusal" if last[2] == "refusal" else None if final(last) else f"judge_parse_error: batch result {last[0]}"
        out[str(i)] = (1 if final(first) else 2, None if error else str(i), error)
    return out


def rows(df):
    found = [(r["custom_id"], (r["attempts"], r["value"], r["error"])) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_two_rounds(spark, options):
    assert rows(batches.run_rounds(work(spark, 60), options["folder"] + "/kept", options, judged)) == want(60)


@pytest.mark.parametrize("at", ["before start", "after start", "before keeping", "before closing"])
def test_a_stopped_run_goes_on(spark, options, monkeypatch, at):
    kept = options["folder"] + "/kept"
    if at in ("before start", "after start"):
        spark.dataSource.register(batches.BatchSource)
        if at == "before start":  # drafts that no commit has started
            batches._service(options).create("r", [{"custom_id": "3", "attempt": 1, "body": "{}"}])
        else:
            work(spark, 60).select("custom_id", F.lit(1).alias("attempt"), "body").write.format(batches.FORMAT).options(**options).mode("append").save()
    else:
        real, calls = batches.collect, []

        def broken(spark, kept, options):
            calls.append(1)
            if len(calls) == 2:
                if at == "before closing":
                    monkeypatch.setattr(batches.FolderService, "close", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
                    real(spark, kept, options)
                raise OSError("stopped")
            real(spark, kept, options)

        monkeypatch.setattr(batches, "collect", broken)
        with pytest.raises(OSError, match="stopped"):
            batches.run_rounds(work(spark, 60), kept, options, judged)
        monkeypatch.undo()
    assert rows(batches.run_rounds(work(spark, 60), kept, options, judged)) == want(60)
    answers = spark.read.parquet(kept)
    assert answers.count() == answers.select("custom_id", "attempt").distinct().count() == sum(a for a, _, _ in want(60).values())
    assert batches._service(options).open_batches("r") == []
    again = rows(batches.run_rounds(work(spark, 60), kept, options, judged))  # nothing is asked once more
    assert again == want(60) and spark.read.parquet(kept).count() == answers.count()


def test_stuck_batches_are_cancelled_and_asked_again(spark, options):
    options |= {"answer": "tests.test_batches:stuck", "cancel_after_seconds": "0.05", "poll_seconds": "0.02"}
    found = rows(batches.run_rounds(work(spark, 20), options["folder"] + "/kept", options, judged))
    assert found == {str(i): (2 if i % 4 == 0 else 1, "1", None) for i in range(20)}


def test_guard():
    g = batches.StaleGuard(10)
    assert not g.stale("in_progress", (5, 0, 0, 0, 0), 0) and not g.stale("in_progress", (5, 0, 0, 0, 0), 9)
    assert not g.stale("in_progress", (4, 1, 0, 0, 0), 11) and not g.stale("ended", (4, 1, 0, 0, 0), 30)
    assert g.stale("in_progress", (4, 1, 0, 0, 0), 31) and not g.stale("in_progress", (4, 1, 0, 0, 0), 60)
    assert not batches.StaleGuard(None).stale("in_progress", (1,), 1e9)


def test_no_work(spark, options):
    assert rows(batches.run_rounds(work(spark, 0), options["folder"] + "/kept", options, judged)) == {}


def test_a_batch_is_answered_once(tmp_path, monkeypatch):
    """However often it is polled before its results are read."""
    service = batches.FolderService({"folder": f"file://{tmp_path}", "answer": "tests.test_batches:answer", "polls": "3"})
    asked = []
    monkeypatch.setattr(service, "answer", lambda c, attempt: asked.append(c) or ("succeeded", c, "end_turn"))
    for part in ("ab", "cd"):
        batch = service.create("r", [{"custom_id": c, "attempt": 1, "body": ""} for c in part])
        service.start(batch)
        assert [r[1] for r in batches.collected(service, batch, 0, None)] == list(part)
    assert asked == list("abcd")
