"""Watched runs: streams stopped anywhere give what a plain walk over the rows gives."""

import datetime as dt
import random

import pytest

from criterium.streaming import budget

EPOCH = dt.datetime(2024, 1, 1)
BUDGET, STALL, EVERY = 5_000_000_000, 700_000_000, 4


def plain(rows):
    runs, last, out = {}, max(at for _, at, _ in rows), []
    for run, at, counter in sorted(rows):
        runs.setdefault(run, []).append((at, counter))
    for run, own in runs.items():
        end = own[0][0] + BUDGET
        steps = lambda t: sum(at < t for at, _ in own)
        moved = [own[0]] + [b for a, b in zip(own, own[1:]) if a[1] != b[1]]
        for i, (at, _) in enumerate(moved):
            until = moved[i + 1][0] if i + 1 < len(moved) else last
            if at + STALL < end and at + STALL <= until:
                out.append((run, "stall", at + STALL, steps(at + STALL)))
        if end <= last:
            out.append((run, "budget", end, steps(end)))
    return sorted((*o, o[3] // EVERY * EVERY) for o in out)


@pytest.mark.parametrize(("seed", "slices"), [(1, 1), (1, 4), (2, 3)])
def test_slices_equal_a_plain_walk(spark, seed, slices):
    draw, rows = random.Random(seed), []
    for run in range(30):
        at = draw.randrange(3_000_000_000)
        for _ in range(draw.randrange(1, 60)):
            rows.append((run, at, draw.choice("aab")))
            at += draw.choice([1_000_000, 150_000_000, 400_000_000])
    rows.append((99, 12_000_000_003, "z"))
    df = spark.createDataFrame([(r, EPOCH + dt.timedelta(microseconds=a), c) for r, a, c in rows], "run long, at timestamp, counter string").repartition(3)
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = sorted((r["run"], r["kind"], r["at_us"] - base, r["step"], r["resume_step"]) for r in budget.in_slices(df, slices, BUDGET, STALL, EVERY).collect())
    assert got == plain(rows) and {g[1] for g in got} == {"stall", "budget"}


def test_no_rows(spark):
    assert budget.in_slices(spark.createDataFrame([], budget.LANDED), 2, BUDGET, STALL, EVERY).count() == 0
