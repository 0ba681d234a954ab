"""Admission by a sliding log of admitted requests, in batch and as a stream; and incremental facts by content hash."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.scratch import bound_batches


def quota(user: Column, ip: Column) -> tuple[Column, Column]:
    """(key, limit): signed-in users have their own key and the higher limit."""
    signed = user.isNotNull() & (user != "") & (user != "anonymous")
    return F.when(signed, F.concat(F.lit("user_"), user)).otherwise(F.concat(F.lit("ip_"), ip)), F.when(signed, fixed.USER_LIMIT).otherwise(fixed.PUBLIC_LIMIT)


ADMITTED = "id long, allowed boolean, remaining int, retry_after long"


def admit(requests: DataFrame, window_ms: int = fixed.WINDOW_MS) -> DataFrame:
    """Requests (key, id, ms, max_n) with allowed, remaining and retry_after (seconds, null if allowed).

    A request is admitted if fewer than max_n admitted ones of its key are younger than the window; refused ones leave no trace, so this
    is a fold in time order and not a window frame. One shuffle by key and one sort (which spills); then each task goes through its rows once and
    holds the live admissions of one key, at most its largest max_n.
    """
    bound_batches(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = object(), deque()
        for batch in batches:
            keys, out = batch.column("key").to_pylist(), []
            for k, i, ms, most in zip(keys, *(batch.column(c).to_pylist() for c in ("id", "ms", "max_n")), strict=True):
                if k != key:
                    key, log = k, deque()
                while log and ms - log[0] >= window_ms:
                    log.popleft()
                ok = len(log) < most
                if ok:
                    log.append(ms)
                out.append((i, ok, most - len(log) if ok else 0, None if ok else max(1, -(-(log[0] + window_ms - ms) // 1000)) if log else None))
            if out:
                types = (pa.int64(), pa.bool_(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=["key", "id", "allowed", "remaining", "retry_after"])

    rows = requests.select("key", F.col("id").cast("long").alias("id"), F.col("ms").cast("long").alias("ms"), F.col("max_n").cast("int").alias("max_n"))
    return rows.repartition("key").sortWithinPartitions("key", "ms", "id", "max_n").mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {ADMITTED}")


def admit_stream(requests: DataFrame, window_ms: int = fixed.WINDOW_MS) -> DataFrame:
    """The same for a stream of (key, id, ms, max_n): the state of a key is its live admissions, dropped when the key is idle for a window.

    Requests of a micro-batch are folded in time order; a batch that comes late is judged on the state it finds.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["ms", "id"])
        out = []
        for ms, i, most in zip(rows["ms"], rows["id"], rows["max_n"], strict=True):
            log = [t for t in log if ms - t < window_ms]
            ok = len(log) < most
            if ok:
                log.append(int(ms))
            out.append((key[0], int(i), ok, int(most) - len(log) if ok else 0, None if ok else max(1, -(-(log[0] + window_ms - int(ms)) // 1000))))
        state.update((log,))
        state.setTimeoutDuration(window_ms)
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "remaining", "retry_after"]).astype({"retry_after": "Int64"})

    return requests.groupBy("key").applyInPandasWithState(run, "key string, id long, allowed boolean, remaining int, retry_after long", "log array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: State store that ``admit_in_event_time`` needs.
EVENT_TIME_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A waiting request as it lies in the state, and so many of them at most in one piece.
REQUEST, PIECE = np.dtype([("ms", "<i8"), ("id", "<i8"), ("max_n", "<i4")]), 10_000


class _Judge(StatefulProcessor):
    """Admissions of one key in event time: requests wait until the watermark has passed them, so that none can come before them any more.

    Each call to the state goes to the JVM and back, so a batch's requests of a key are appended as packed pieces, and a key has one timer alone: at its
    earliest waiting request, or else where its last admission ends.
    """

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "requests binary")
        self.state = handle.getValueState("state", "timer long, admitted array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the names are Spark's
        first = None
        while some := list(islice(rows, PIECE)):
            new = np.array([(x.ms, x.id, x.max_n) for x in some], REQUEST)
            self.waiting.appendValue((new.tobytes(),))
            first = min(x for x in (first, int(new["ms"].min())) if x is not None)
        timer, log = self.state.get() or (None, [])
        if timer is None or first < timer:
            self._wait_for(first, timer, log)
        return iter(())

    def _wait_for(self, timer: int, before: int | None, log: list[int]) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(timer)
        self.state.update((timer, log))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        log = deque(self.state.get()[1])
        pieces = [np.frombuffer(x[0], REQUEST) for x in self.waiting.get()]
        waiting = np.concatenate([np.empty(0, REQUEST), *pieces])
        late = waiting["ms"] > now
        due, rest = np.sort(waiting[~late], order=["ms", "id", "max_n"]), waiting[late]
        for ms, i, most in due.tolist():
            while log and ms - log[0] >= self.window_ms:
                log.popleft()
            ok = len(log) < most
            if ok:
                log.append(ms)
            yield Row(key=key[0], id=i, allowed=ok, remaining=most - len(log) if ok else 0, retry_after=None if ok else max(1, -(-(log[0] + self.window_ms - ms) // 1000)) if log else None)
        while log and now - log[0] >= self.window_ms:
            log.popleft()
        if len(rest) and len(due):
            self.waiting.put([(rest[at : at + PIECE].tobytes(),) for at in range(0, len(rest), PIECE)])
        elif len(due):
            self.waiting.clear()
        if len(rest) or log:
            self._wait_for(int(rest["ms"].min()) if len(rest) else log[-1] + self.window_ms, None, list(log))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def admit_in_event_time(requests: DataFrame, delay: str, window_ms: int = fixed.WINDOW_MS) -> DataFrame:
    """The same for a stream of (key, id, ms, max_n) that comes out of order: equal to ``admit`` over all requests that come at most ``delay`` late.

    A request is judged when the watermark (``delay`` behind the latest request of all keys) passes it, in the order of (ms, id) within its key;
    later ones than that are dropped by Spark. A key's state is its waiting requests and its live admissions; event-time timers judge the first and end
    the last. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = requests.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithState(_Judge(window_ms), outputStructType=f"key string, {ADMITTED}", outputMode="Append", timeMode="EventTime")


def split_by_cache(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files (repo, path, hash, ...) against cached facts (repo, path, hash)."""
    keys = ["repo", "path", "hash"]
    known = cached.select(*keys).distinct()
    return files.join(known, keys, "left_semi"), files.join(known, keys, "left_anti")


def refreshed(cached: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts of the live files: cached ones whose file is unchanged, and fresh ones. Facts of files that are gone are dropped."""
    return cached.join(files.select("repo", "path", "hash"), ["repo", "path", "hash"], "left_semi").unionByName(fresh)


def store_facts(facts: DataFrame, root: str) -> str:
    """Writes facts of the live files as a new version below ``root`` and makes it the current one; the path of the version.

    Readers of the version before are not disturbed; a version that was not finished is never current. Facts of files that are gone are
    not in ``facts`` (see ``refreshed``), so they are evicted.
    """
    spark = facts.sparkSession
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    facts.write.parquet(path)
    order = time.time_ns()
    spark.createDataFrame([(order, path)], "at long, path string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/current")
    return path


def stored_facts(spark: SparkSession, root: str) -> DataFrame | None:
    """Facts of the current version, or None if there is none."""
    try:
        latest = spark.read.parquet(f"{root.rstrip('/')}/current").orderBy(F.desc("at")).first()
    except AnalysisException:
        return None
    return spark.read.parquet(latest.path)


def cache_counts(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(repo, hits, misses)."""
    k = files.join(cached.select("repo", "path", "hash").distinct().withColumn("hit", F.lit(1)), ["repo", "path", "hash"], "left")
    return k.groupBy("repo").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
