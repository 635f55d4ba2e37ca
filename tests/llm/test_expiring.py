"""Expiring windows against a plain replay of the batches, one key after the other."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from criterium.llm import expiring

EPOCH = dt.datetime(1970, 1, 1)
FIELDS = ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]


def plain(batches):
    """batches: lists of (key, hour, hash hex)."""
    out, live, newest = [], {}, None
    for b, rows in enumerate(batches):
        limit = None if newest is None else newest - 48
        for k, hour, digest in sorted(r for r in rows if limit is None or r[1] >= limit):
            w = live.get(k)
            if w and hour <= w[0] + 72:
                w[1] += 1
                if digest != w[4]:
                    w[2], w[3] = w[2] + 1, w[3] + zlib.crc32(digest.encode())
                continue
            if w:
                out.append((k, w[0], b, *w[1:]))
            live[k] = [hour, 0, 0, 0, digest]
        hours = [r[1] for r in rows] + ([] if newest is None else [newest])
        newest = max(hours, default=None)
        for k in [k for k, w in live.items() if b == len(batches) - 1 or newest is not None and w[0] + 72 < newest - 48]:
            w = live.pop(k)
            out.append((k, w[0], b, *w[1:]))
    return sorted(out)


def copies(rows, n=12):
    """The contract's copies of clicks, in plain Python."""
    micros = lambda t: (t - EPOCH) // dt.timedelta(microseconds=1)
    text = lambda x: "" if x is None else str(x)
    found = []
    for r in rows:
        for j in range(r["click_id"] % 3 + 1):
            c = zlib.crc32(f"{r['click_id']}:{j}".encode())
            hour = micros(r["arrived_at"]) // 3_600_000_000 + 6 * j * (c % 10)
            cents = None if r["value"] is None else math.floor(100 * r["value"] + 0.5)
            ts = None if r["ts"] is None else micros(r["ts"])
            fields = "|".join(map(text, (r["client_id"], r["kind"], cents, ts, r["props"], c % 3)))
            found.append((hour + c // 10 % 200, (r["click_id"], hour, hashlib.sha256(fields.encode()).hexdigest())))
    low, high = min(x[0] for x in found), max(x[0] for x in found)
    batches = [[] for _ in range(n)]
    for at, x in found:
        batches[(at - low) * n // (high - low + 1)].append(x)
    return batches


def rows_of(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def test_query_equals_plain_replay(spark, data):
    from criterium.llm.queries import op11_expiring

    want = plain(copies(spark.read.parquet(f"{data}/clicks.parquet").collect()))
    got = rows_of(op11_expiring(spark, data))
    assert len(want) > 2000 and any(w[3] for w in want) and any(w[4] for w in want) and len({w[2] for w in want}) == 12
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_keys_conflicts_and_late_records(spark, seed):
    draw = random.Random(seed)
    batches = [[(draw.choice([7, 7, 7, draw.randrange(400)]), 100 * b + int(draw.expovariate(1 / 60)) - 40, hashlib.sha256(bytes([draw.randrange(3)])).hexdigest()) for _ in range(draw.randrange(600))] for b in range(4)]
    batches[2] = [] if seed == 2 else batches[2]
    rows = [(b, k, h, d) for b, each in enumerate(batches) for k, h, d in each]
    df = spark.createDataFrame(rows, "batch int, key long, hour long, digest string")
    got = expiring.replay(df.repartition(5), F.unhex("digest"), 4).withColumnRenamed("key", "click_id")
    assert rows_of(got) == plain(batches)
    assert any(h < 0 for _, _, h, _ in rows)  # before 1970


def test_small_buckets_read_and_store_their_state_alike(spark, monkeypatch):
    """Keys read one by one, and whole maps written anew, give the same windows."""
    draw = random.Random(5)
    batches = [[(draw.randrange(3000) if b % 2 == 0 else draw.randrange(20), 60 * b + draw.randrange(60), "%064x" % draw.randrange(2)) for _ in range(2500 if b % 2 == 0 else 40)] for b in range(5)]
    df = spark.createDataFrame([(b, k, h, d) for b, each in enumerate(batches) for k, h, d in each], "batch int, key long, hour long, digest string")
    monkeypatch.setattr(expiring, "BUCKETS", 2)
    got = expiring.replay(df, F.unhex("digest"), 5).withColumnRenamed("key", "click_id")
    assert rows_of(got) == plain(batches)


def test_no_store_stays_open_after_its_task(spark):
    """A start's stores are closed when it has ended; they held native memory beside those of later starts."""
    df = spark.createDataFrame([(k % 2, k, k % 2, "%064x" % 1) for k in range(40)], "batch int, key long, hour long, digest string")
    memory = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.streaming.state, "RocksDBMemoryManager$"), "MODULE$")
    before = memory.getNumRocksDBInstances(True)
    assert expiring.replay(df, F.unhex("digest"), 2).count() == 40
    assert memory.getNumRocksDBInstances(True) <= before


def test_a_batch_opens_the_stores_once(spark, monkeypatch):
    """Every store that is opened leaves native memory behind; a start for what the last batch leaves open took two rounds of stores more."""
    commits, remove = [], expiring.remove

    def seen(spark, path):
        if path.endswith("/checkpoint"):
            commits.extend(p.name for p in Path(path.removeprefix("file://"), "commits").iterdir() if p.name.isdigit())
        remove(spark, path)

    monkeypatch.setattr(expiring, "remove", seen)
    batches = [[(k, 200 * b, "%064x" % 1) for k in range(b, 20)] for b in (0, 1)] + [[], [(3, 500, "%064x" % 2)], []]
    df = spark.createDataFrame([(b, *r) for b, each in enumerate(batches) for r in each], "batch int, key long, hour long, digest string")
    assert rows_of(expiring.replay(df, F.unhex("digest"), 5).withColumnRenamed("key", "click_id")) == plain(batches)
    assert sorted(map(int, commits)) == [0, 1, 2, 3]  # batches with records, and the last


def test_stores_hold_no_native_memory(spark, monkeypatch):
    """A RocksDB keeps its statistics after it is closed, so a run's starts added up: over 3,000 MB with 211 partitions."""
    queries, start = [], DataStreamWriter.start

    def started(self, *args, **options):
        queries.append(start(self, *args, **options))
        return queries[-1]

    monkeypatch.setattr(DataStreamWriter, "start", started)
    df = spark.createDataFrame([(k % 2, k, k % 2, "%064x" % 1) for k in range(40)], "batch int, key long, hour long, digest string")
    assert expiring.replay(df, F.unhex("digest"), 2).count() == 40
    metrics = {m for q in queries for p in q.recentProgress for o in p.stateOperators for m in o.customMetrics}
    assert len(queries) == 2 and metrics and not [m for m in metrics if "rocksdb" in m.lower()]


def test_a_bucket_without_records_closes_in_time(spark):
    """Its timeout is kept from start to start, and set anew for the windows that stay."""
    batches = [[(k, 40 * (k % 3), "%064x" % k) for k in range(30)], *([(99, h, "%064x" % 1)] for h in (150, 180, 210, 500, 510))]
    df = spark.createDataFrame([(b, *r) for b, each in enumerate(batches) for r in each], "batch int, key long, hour long, digest string")
    got = rows_of(expiring.replay(df, F.unhex("digest"), 6).withColumnRenamed("key", "click_id"))
    assert got == plain(batches) and {r[2] for r in got if r[0] < 30} == {1, 2, 3}


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, bucket int"


def test_odd_rows(spark):
    at = dt.datetime(2024, 1, 1, 5, 30)
    good = [(2, at, at, 1, "a|b", -0.005, None), (2, at, at, 1, "a|b", -0.005, None), (3, None, at, None, None, None, "x" * 100_000), (4, at, at + dt.timedelta(hours=90), 1, "", 1e15, "")]
    odd = [(None, at, at, 1, "k", 1.0, "p"), (5, at, None, 1, "k", 1.0, "p")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in good + odd], SCHEMA)
    names = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]
    want = plain(copies([dict(zip(names, r)) for r in good], 3))
    assert rows_of(expiring.click_windows(df, 3)) == want
    assert rows_of(expiring.click_windows(df.limit(0))) == []
    assert expiring.click_windows(df.limit(0)).columns == FIELDS


def test_times_without_a_zone_are_utc_in_any_session(spark):
    at = dt.datetime(2024, 3, 31, 2, 30)
    df = spark.createDataFrame([(3, at, at, 1, "k", 1.0, "p", "", 1)], SCHEMA)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        row = expiring.click_copies(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["ts"] == (at - EPOCH) // dt.timedelta(microseconds=1) and row["hour"] == row["ts"] // 3_600_000_000
