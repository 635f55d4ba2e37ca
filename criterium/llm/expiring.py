"""Expiring deduplication of keyed records: a stream with state and event-time timeouts over hashed buckets.

Records (key, hour, hash) come in batches. In a batch those of a key go by hour, then hash: a record up to
``SPAN`` hours after the start of the key's open window repeats it, any other closes it and opens the next.
Records more than ``LATE`` hours older than the newest hour of earlier batches are dropped; windows that end
before that limit close.

Keys are hashed to buckets; a bucket is one group of ``applyInPandasWithState``. Its state is the array of its
open windows by key, its timeout the earliest end of one: without new records it is called when the watermark
has passed that. Before the shuffle every Arrow batch counts equal records and packs what is left of a bucket
into one row, so a hot key's repeats are counted where they are read; what a bucket holds in one batch at a
time are its distinct (key, hour, hash), and its open windows.
Windows that the bucket's own newest hour already ends are given out at once and never enter the state.
The last batch brings every bucket an empty pack besides, and closes all there and then.

The state store is the one whose maps lie in the heap and whose files lie under the checkpoint, not RocksDB:
a run starts its query once a batch, every start opens a store a partition, and of each RocksDB that it opened
Spark keeps half a megabyte of native statistics for good.

Defined cases: rows without key or hour have no records; a first batch drops nothing, hours before 1970
included; equal rows are repeats of each other; without records there are no rows; batches without records
close nothing; other columns are left aside; of a value that is not a number the long is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from criterium.llm.common import fresh_path, lean, move, remove

#: Hours that a window takes repeats, and hours that records may be late.
SPAN, LATE = 72, 48

#: Records a bucket gets in all, on average, which bounds the windows that it holds; and the least number of buckets.
RECORDS, BUCKETS = 393_216, 64

HOUR_MS = 3_600_000
_HASH = ("h0", "h1", "h2", "h3")
_RECORD = np.dtype([("key", "i8"), ("hour", "i8"), ("n", "i8"), *((h, "u8") for h in _HASH)])
_PACKS = pa.schema([("bucket", pa.int64()), ("event_time", pa.timestamp("us", "UTC")), ("pack", pa.binary())])
#: A window in the state.
_WINDOW = np.dtype([("key", "i8"), ("start", "i8"), ("repeats", "i8"), ("conflicts", "i8"), ("crc", "i8"), *((h, "u8") for h in _HASH)])
WINDOWS = "key bigint, start_hour bigint, closed_batch bigint, n_repeats bigint, n_conflicts bigint, conflict_crc bigint, hash string"


def _combined(rows: np.ndarray, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows by bucket, key, hour and hash, equal ones as one with the sum of ``n``."""

    def placed(columns: tuple[str, ...]):
        order = np.lexsort([rows[c] for c in columns] + ([] if bucket is None else [bucket]))
        by = rows[order]
        place = np.ones(max(0, len(by) - 1), bool)  # as the row before, but for the rest of the hash
        for c in ("key", "hour", "h0"):
            place &= by[c][1:] == by[c][:-1]
        same = place.copy()
        for c in ("h1", "h2", "h3"):
            same &= by[c][1:] == by[c][:-1]
        return order, by, place, same

    order, by, place, same = placed(("h0", "hour", "key"))
    if (place != same).any():  # hashes that agree in 64 of their 256 bits
        order, by, place, same = placed(("h3", "h2", "h1", "h0", "hour", "key"))
    rows, new = by, np.r_[True, ~same][: len(by)]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(rows["n"], first) if len(rows) else rows["n"]
    rows = rows[first]
    rows["n"] = counts
    return rows, None if bucket is None else bucket[order][first]


def _packed(origin: int, buckets: int) -> Callable:
    """mapInArrow: (bucket, key, hour, hash) -> a row per bucket and Arrow batch; a row without a key is an empty one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in pa.compute.indices_nonzero(batch.column("key").is_null()).to_pylist():
                out.extend((b, batch.column("hour")[at].as_py(), b"") for b in range(buckets))
            batch = batch.filter(batch.column("key").is_valid())
            if batch.num_rows:
                rows = np.zeros(batch.num_rows, _RECORD)
                rows["key"], rows["hour"], rows["n"] = batch.column("key").to_numpy(), batch.column("hour").to_numpy(), 1
                digests = np.frombuffer(batch.column("hash").cast(pa.binary(32)).buffers()[1], ">u8").reshape(-1, 4)[batch.column("hash").offset :][: batch.num_rows]
                for k, h in enumerate(_HASH):
                    rows[h] = digests[:, k]
                rows, bucket = _combined(rows, batch.column("bucket").to_numpy())
                ends = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(rows)]
                for a, b in zip([0, *ends[:-1]], ends):
                    out.append((int(bucket[a]), int(rows["hour"][a:b].max()), rows[a:b].tobytes()))
            if out:
                times = pa.array([(h - origin) * HOUR_MS * 1000 for _, h, _ in out], pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.record_batch([pa.array([b for b, _, _ in out], pa.int64()), times, pa.array([p for _, _, p in out], pa.binary())], schema=_PACKS)

    return run


def _hexed(rows: np.ndarray) -> list[str]:
    """The hashes of records or windows in lowercase hex."""
    digests = np.stack([rows[h] for h in _HASH], 1).astype(">u8").tobytes().hex()
    return [digests[64 * i : 64 * i + 64] for i in range(len(rows))]


def _passed(got: np.ndarray, held: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Records by key, hour and hash, and open windows -> the windows that the records close, and those open after them.

    The windows of all keys are found side by side: a round looks up where the window of each key ends, and opens the next there.
    """
    if not len(got):
        return held[:0], held
    keys, first, rank = np.unique(got["key"], return_index=True, return_inverse=True)
    end = np.r_[first[1:], len(got)]
    low = int(got["hour"].min())
    width = int(got["hour"].max()) - low + span + 2
    place = rank * width + (got["hour"] - low)
    at = np.searchsorted(keys, held["key"])
    met = at < len(keys)
    met[met] = keys[at[met]] == held["key"][met]

    of = at[met]
    until = np.searchsorted(place, of * width + np.clip(held["start"][met] + span - low, -1, width - 1), "right")
    rounds = [(of, first[of], until, held[met])]
    since = first.copy()
    since[of] = until
    of = np.flatnonzero(since < end)
    while len(of):
        begin = since[of]
        opened = np.zeros(len(of), _WINDOW)
        opened["key"], opened["start"], opened["repeats"] = keys[of], got["hour"][begin], -1  # the opener repeats nothing
        for h in _HASH:
            opened[h] = got[h][begin]
        until = np.searchsorted(place, of * width + (opened["start"] + span - low), "right")
        rounds.append((of, begin, until, opened))
        since[of] = until
        of = of[until < end[of]]

    of, begin, until, windows = map(np.concatenate, zip(*rounds))
    counted = np.r_[0, np.cumsum(got["n"])]
    windows["repeats"] += counted[until] - counted[begin]
    some = np.flatnonzero(begin < until)
    some = some[np.argsort(begin[some])]
    owner = np.repeat(some, (until - begin)[some])  # of every record, its window
    unlike = np.flatnonzero(np.any([got[h] != windows[h][owner] for h in _HASH], 0))
    crc = np.array([zlib.crc32(x.encode()) for x in _hexed(got[unlike])], "i8")
    np.add.at(windows["conflicts"], owner[unlike], got["n"][unlike])
    np.add.at(windows["crc"], owner[unlike], got["n"][unlike] * crc)

    newest = np.zeros(len(keys), "i8")
    newest[of] = np.arange(len(of))  # the last round's stays
    live = np.zeros(len(windows), bool)
    live[newest] = True
    return windows[~live], np.concatenate([windows[live], held[~met]])


def _expiring(batch: int, before: int, origin: int, last: bool, span: int, late: int) -> Callable:
    """applyInPandasWithState for one bucket; ``batch`` is the number of the batch that this start of the query brings, ``before`` that of the
    last one before it that had records, ``origin`` hour 0 of its event time; ``last`` says that no batch comes after it, and that every bucket has a row.

    A window whose end the batch before has passed is given out with the next batch that comes, and counts as closed
    by the one before: the watermark stands still while a batch is worked on.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        got = np.frombuffer(b"".join(p for f in frames for p in f["pack"]), _RECORD)
        if batch:
            got = got[(got["hour"] - origin) * HOUR_MS > watermark]
        got, _ = _combined(got)
        held = np.frombuffer(state.get[0] if state.exists else b"", _WINDOW)
        # ends under this hour had passed when the batch came
        past = held["start"] + span < watermark // HOUR_MS + 1 + origin
        closed, live = _passed(got, held[~past], span)
        # what lies this far behind the bucket's own newest hour ends with this batch, whatever the other buckets have
        ended = live["start"] + span < int(got["hour"].max()) - late if len(got) and not last else np.full(len(live), last)
        given = np.concatenate([held[past], closed, live[ended]])
        live = live[~ended]
        if len(live):
            state.update((live.tobytes(),))
            state.setTimeoutTimestamp((int(live["start"].min()) + span - origin) * HOUR_MS + 1000)
        elif state.exists:
            state.remove()
        if len(given):
            by = np.repeat([before, batch], [past.sum(), len(given) - past.sum()])
            columns = (given["key"], given["start"], by, given["repeats"], given["conflicts"], given["crc"], _hexed(given))
            yield pd.DataFrame(dict(zip(_names(WINDOWS), columns)))

    return run


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def closed_windows(records: DataFrame, batch: int, before: int, origin: int, buckets: int, *, last: bool = False, span: int = SPAN, late: int = LATE) -> DataFrame:
    """A stream of (key long, hour long, hash binary of 32 bytes) -> the windows that close, for one start of the query."""
    keyed = records.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long").alias("bucket"), "key", "hour", "hash")
    packs = keyed.mapInArrow(lean(_packed(origin, buckets)), "bucket long, event_time timestamp, pack binary")
    # hours are whole, so one millisecond more than the limit drops what is older than it, and nothing at it
    packs = packs.withWatermark("event_time", f"{late} hours 1 milliseconds")
    return packs.groupBy("bucket").applyInPandasWithState(_expiring(batch, before, origin, last, span, late), WINDOWS, "windows binary", "append", GroupStateTimeout.EventTimeTimeout)


_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # a start is one micro-batch: a store is closed with its task, so an executor holds as many as it runs tasks, not one a partition and start
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # a start reads the versions since the last whole one, and each has all windows of the buckets that changed
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def replay(records: DataFrame, digest: Column, batches: int, *, span: int = SPAN, late: int = LATE) -> DataFrame:
    """Records with (batch int, key long, hour long) and what ``digest`` is made of -> closed windows.

    The records are written once, by batch, under ``spark.checkpoint.dir``. Each batch's folder is then moved
    into the folder that the query watches, and the query started anew on one checkpoint until it has taken
    it in; the last batch has one record without a key besides, at which every window closes.
    """
    spark = records.sparkSession
    root = fresh_path(spark, "expiring")
    records = records.where(F.col("key").isNotNull() & F.col("hour").isNotNull() & F.col("batch").between(0, batches - 1))
    records.write.option("compression", "zstd").partitionBy("batch").parquet(f"{root}/staged")
    staged = spark.read.schema(records.schema).parquet(f"{root}/staged")
    oldest, newest, n = staged.agg(F.min("hour"), F.max("hour"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], WINDOWS)
    buckets = max(BUCKETS, -(-n // RECORDS))
    origin = oldest - 2 * (span + late) - 1000
    closing = spark.range(1).select(*(F.lit(newest).alias(c) if c == "hour" else F.lit(None).cast(t).alias(c) for c, t in records.dtypes if c != "batch"))
    closing.write.mode("append").parquet(f"{root}/staged/batch={batches - 1}")

    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        had = -1
        for batch in range(batches):
            came = move(spark, f"{root}/staged/batch={batch}", f"{root}/landed/batch={batch}")
            landed = spark.readStream.schema(records.schema).parquet(f"{root}/landed")
            rows = landed.select("key", "hour", digest.alias("hash"))
            closed = closed_windows(rows, batch, had, origin, buckets, last=batch == batches - 1, span=span, late=late)
            query = closed.writeStream.format("parquet").option("path", f"{root}/closed").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            had = batch if came else had
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    remove(spark, f"{root}/landed")
    remove(spark, f"{root}/checkpoint")
    return spark.read.schema(WINDOWS).parquet(f"{root}/closed")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _micros(clicks: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time in UTC; one without a zone is taken to be UTC, whatever the session's."""
    at = F.col(name).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(at, clicks.sparkSession.conf.get("spark.sql.session.timeZone")) if dict(clicks.dtypes)[name] == "timestamp_ntz" else at)


def click_copies(clicks: DataFrame, batches: int = 12) -> DataFrame:
    """clicks -> the copies of every row with the batch, hour and fields they arrive with."""
    rows = clicks.select("click_id", "client_id", "kind", "value", "props", _micros(clicks, "ts").alias("ts"), F.floor(_micros(clicks, "arrived_at") / 3_600_000_000).alias("arrived"))
    rows = rows.where(F.col("click_id").isNotNull() & F.col("arrived").isNotNull())
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), (F.pmod("click_id", F.lit(3))).cast("int"))))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", "click_id", "j").cast("binary")))
    rows = rows.withColumn("hour", F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)).withColumn("l", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    low, high = rows.agg(F.min("l"), F.max("l")).first()
    batch = F.floor((F.col("l") - F.lit(low)) * batches / (F.lit(high) - F.lit(low) + 1)) if low is not None else F.lit(0)
    return rows.select(
        batch.cast("int").alias("batch"), F.col("click_id").alias("key"), F.col("hour").cast("long").alias("hour"), "client_id", "kind",
        F.floor(100 * F.col("value") + 0.5).cast("long").alias("cents"), "ts", "props", (F.col("c") % 3).alias("variant"),
    )


def click_digest() -> Column:
    """The 32 bytes of the sha256 of a copy's fields, bars between them."""
    parts = [x for c in ("client_id", "kind", "cents", "ts", "props", "variant") for x in (F.lit("|"), _text(F.col(c)))][1:]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def click_windows(clicks: DataFrame, batches: int = 12) -> DataFrame:
    """clicks -> click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash."""
    return replay(click_copies(clicks, batches), click_digest(), batches).withColumnRenamed("key", "click_id")
