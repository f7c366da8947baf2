"""Request budgets and request logs as streams.

The budgets are stateful operators in event time. A request waits in the state of its key
until the watermark has passed it, so requests may arrive in any order within the lateness
and are judged in time order, as the batch operators do. What arrives behind the watermark
cannot be judged any more and leaves at once, marked late. Timers judge what is due and
drop what no longer counts, so the state holds the requests of the last ``lateness`` and
the accepted hits of one window, however old the stream is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from filingloom import constants as C
from filingloom.operators.requests import _walk, request_log

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS, WINDOW_BUCKETS = 256, 64
_CHUNK = 20_000  # rows in a state value at most
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_REQUEST = "client string, anonymous boolean, event_id bigint, ts_us bigint"
_VERDICT = "allowed boolean, remaining bigint, reset_seconds bigint, late boolean"
_SLIDING_OUT = f"{_REQUEST}, {_VERDICT}"
_FIXED_OUT = f"{_REQUEST}, window_no bigint, hit_no bigint, {_VERDICT}"

_HELD = pa.schema([("client", pa.string()), ("anonymous", pa.bool_()), ("event_id", pa.int64()), ("ts_us", pa.int64())])
_HITS = pa.schema([("client", pa.string()), ("anonymous", pa.bool_()), ("ts_us", pa.int64())])


def _pack(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """Rows as one state value: a call to the state store costs more than many rows."""
    return (pa.RecordBatch.from_pandas(rows, schema, preserve_index=False).serialize().to_pybytes(),)


def _unpack(values, schema: pa.Schema) -> pd.DataFrame:
    batches = [pa.ipc.read_record_batch(pa.py_buffer(value[0]), schema) for value in values]
    return pa.Table.from_batches(batches, schema).to_pandas()


class _Budget(StatefulProcessor):
    """Holds the requests of a bucket of clients until the watermark has passed them;
    subclasses judge them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "requests binary")

    def wake(self, micros: int, mark: int) -> None:
        """Sees to a timer that fires when the watermark, now at ``mark``, has passed a time."""
        at = micros // 1000 + 1
        # timers behind the mark fire in this batch
        if not any(mark < t * 1000 and t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = None
        for frame in rows:
            # a row without an id only moves time on
            frame = frame[frame["event_id"].notna()]
            late = (frame["ts_us"] <= mark) & (mark > 0)
            if late.any():
                yield self.frame(key, frame[late], late=True)
            held = frame[~late]
            if len(held):
                self.waiting.appendValue(_pack(held[_HELD.names].astype({"event_id": "int64"}), _HELD))
                first = int(held["ts_us"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.wake(int(self.due(key, earliest)), mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpack(self.waiting.get(), _HELD)
        due = self.due(key, held["ts_us"].to_numpy())
        ready = due <= mark
        if ready.any():
            now = held[ready]
            # no client sorts as a client of its own
            client = pd.factorize(now["client"])[0] * 2 + now["anonymous"].to_numpy()
            order = np.lexsort((now["event_id"], now["ts_us"], client))
            now, client = now.iloc[order], client[order]
            edges = np.concatenate([[0], np.flatnonzero(client[1:] != client[:-1]) + 1, [len(now)]])
            yield self.frame(key, now, late=False, **self.judge(now, edges, mark))
            left = held[~ready]
            if len(left):
                self.waiting.put([_pack(left[k : k + _CHUNK], _HELD) for k in range(0, len(left), _CHUNK)])
            else:
                self.waiting.clear()
        if not ready.all():
            self.wake(int(due[~ready].min()), mark)
        self.forget(mark)

    def frame(self, key, rows: pd.DataFrame, late: bool, **verdict) -> pd.DataFrame:
        n = len(rows)
        columns = {name: rows[name].to_numpy() for name in _HELD.names} | self.told(key, n)
        columns |= {name: verdict.get(name, [None] * n) for name in self.verdict}
        return pd.DataFrame({**columns, "late": [late] * n}).astype({"event_id": "int64", "ts_us": "int64", **self.kinds})

    def told(self, key, n: int) -> dict:
        """What the key says about its rows."""
        return {}

    def due(self, key, micros):
        """The times that the watermark must have passed before requests are judged."""
        return micros

    def forget(self, mark: int) -> None:
        """Drops state that no longer counts."""

    def close(self) -> None:
        pass


class _Sliding(_Budget):
    verdict = ("allowed", "remaining", "reset_seconds")
    kinds = {"allowed": "boolean", "remaining": "Int64", "reset_seconds": "Int64"}

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hits = handle.getListState("hits", "hits binary")

    def judge(self, rows: pd.DataFrame, edges: np.ndarray, mark: int) -> dict:
        live: dict[tuple, deque] = {}
        before = _unpack(self.hits.get(), _HITS)
        for client, anonymous, hit in zip(*(before[c].tolist() for c in _HITS.names)):
            live.setdefault((client, anonymous), deque()).append(hit)
        times, firsts = rows["ts_us"].to_numpy(), rows.iloc[edges[:-1]]
        found = []
        for *client, start, stop in zip(firsts["client"], firsts["anonymous"], edges[:-1], edges[1:]):
            hits = live.setdefault(tuple(client), deque())
            found.append(_walk(times[start:stop], hits, self.limit, self.window))
        # what is judged from now on is behind the mark
        kept = [(*client, t) for client, hits in live.items() for t in hits if t + self.window > mark]
        if kept:
            hits = pd.DataFrame(kept, columns=_HITS.names)
            self.hits.put([_pack(hits[k : k + _CHUNK], _HITS) for k in range(0, len(hits), _CHUNK)])
        else:
            self.hits.clear()
        return dict(zip(self.verdict, map(np.concatenate, zip(*found))))

    def forget(self, mark: int) -> None:
        hits = _unpack(self.hits.get(), _HITS)["ts_us"]
        if not len(hits):
            return
        last = int(hits.max()) + self.window
        if last <= mark:
            self.hits.clear()
        else:
            self.wake(last, mark)


class _Fixed(_Budget):
    """Its key holds the number of the window, which is judged as a whole when it has passed."""

    verdict = ("hit_no", "allowed", "remaining", "reset_seconds")
    kinds = {"hit_no": "Int64", **_Sliding.kinds}

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def told(self, key, n: int) -> dict:
        return {"window_no": [int(key[1])] * n}

    def due(self, key, micros):
        return micros * 0 + (int(key[1]) + 1) * self.window - 1

    def judge(self, rows: pd.DataFrame, edges: np.ndarray, mark: int) -> dict:
        times, sizes = rows["ts_us"].to_numpy(), np.diff(edges)
        hit = np.arange(1, len(times) + 1) - np.repeat(edges[:-1], sizes)
        left = (np.repeat(times[edges[:-1]], sizes) + self.window - times + 500_000) // 1_000_000
        return {
            "hit_no": hit,
            "allowed": hit <= self.limit,
            "remaining": np.maximum(self.limit - hit, 0),
            "reset_seconds": np.where(left > 0, left, self.window // 1_000_000),
        }


def _timed(requests: DataFrame, lateness: str, buckets: int) -> DataFrame:
    """(bucket, client, anonymous, event_id, ts_us) behind a watermark; the time column itself
    is gone, so that late rows reach the operator."""
    return (
        requests.where("ts IS NOT NULL")
        .withWatermark("ts", lateness)
        .select(
            F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int").alias("bucket"),
            F.coalesce("client", F.lit("")).alias("client"),
            F.col("client").isNull().alias("anonymous"),
            F.col("event_id").cast("long").alias("event_id"),
            F.unix_micros("ts").alias("ts_us"),
        )
    )


def _named(judged: DataFrame, *columns: str) -> DataFrame:
    return judged.select(
        F.when(~F.col("anonymous"), F.col("client")).alias("client"),
        "event_id",
        F.timestamp_micros("ts_us").alias("ts"),
        *columns,
        "late",
    )


def sliding_limit_stream(
    requests: DataFrame,
    lateness: str,
    limit: int = 60,
    window_seconds: int = C.WINDOW_SECONDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming form of the rolling budget: the verdicts of the batch form, and ``late``.

    Needs (client, event_id, ts). Requests without a client share one budget, those without
    a time are left out. A row without ``event_id`` has no verdict: as a heartbeat it moves
    the watermark on. ``lateness`` is an interval such as ``10 minutes``. Late requests have
    no verdict and do not count.

    Clients are dealt over ``buckets``, which share their calls to the state store. A task
    holds the waiting requests of one bucket; the number stays for the life of a checkpoint.
    """
    judged = (
        _timed(requests, lateness, buckets)
        .groupBy("bucket")
        .transformWithStateInPandas(
            _Sliding(limit, window_seconds * 1_000_000), _SLIDING_OUT, outputMode="append", timeMode="eventTime"
        )
    )
    return _named(judged, "allowed", "remaining", "reset_seconds")


def fixed_limit_stream(
    requests: DataFrame,
    lateness: str,
    limit: int = 60,
    window_seconds: int = C.WINDOW_SECONDS,
    buckets: int = WINDOW_BUCKETS,
) -> DataFrame:
    """Streaming form of the fixed-window counter, as :func:`sliding_limit_stream`.

    The state of a bucket's window lives until the watermark has passed its end, so a busy
    client is spread over its windows.
    """
    window = window_seconds * 1_000_000
    number = F.floor(F.col("ts_us") / F.lit(window)).cast("long")
    judged = (
        _timed(requests, lateness, buckets)
        .withColumn("window_no", number)
        .groupBy("bucket", "window_no")
        .transformWithStateInPandas(_Fixed(limit, window), _FIXED_OUT, outputMode="append", timeMode="eventTime")
    )
    return _named(judged, "window_no", "hit_no", "allowed", "remaining", "reset_seconds")


def start_budget(judged: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends verdicts and late requests to Parquet below ``path``, apart by ``late``.

    Sets the state store that the operators need, for this query only. ``trigger`` is passed
    on; ``availableNow=True`` ends the query when all files that are there have been read.
    """
    spark = judged.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = judged.writeStream.format("parquet").partitionBy("late").outputMode("append")
        writer = writer.option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def read_budget(spark: SparkSession, path: str, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and late requests that :func:`start_budget` has written."""
    rows = spark.read.schema(judged.schema).parquet(path)
    return rows.where("NOT late").drop("late"), rows.where("late").select("client", "event_id", "ts")


def window_counts_stream(
    requests: DataFrame, window_seconds: int = C.WINDOW_SECONDS, lateness: str = "10 minutes", limit: int = 60
) -> DataFrame:
    """Requests and requests over the limit per client and window, JVM-side only."""
    window = F.window("ts", f"{window_seconds} seconds")
    return (
        requests.withWatermark("ts", lateness)
        .groupBy("client", window.alias("window"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "client",
            F.col("window.start").alias("window_start"),
            "requests",
            F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"),
        )
    )


def write_request_log(requests: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Request records appended to Parquet; the checkpoint makes restarts exact."""
    return (
        request_log(requests)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
