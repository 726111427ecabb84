"""Structured Streaming: change feeds into a change log or a keyed table, and a rate limiter."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changefeed import ChangeLog
from ..operators.dml import latest


def stream_to_changelog(feed: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch of a feed to a change log. Appending needs no state, and reading resolves order and repeats, so a batch that runs twice does no harm."""

    def append(batch: DataFrame, _: int) -> None:
        ChangeLog(batch.sparkSession, path).append(batch)

    return feed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: After so many micro-batches their parts are folded into one state.
FOLD = 16


def stream_upserts(feed: DataFrame, path: str, checkpoint: str, key: str, seq: str, deleted: str, fold: int = FOLD, **trigger) -> StreamingQuery:
    """Keep the last state of each key under ``path``; rows (key, seq, deleted, ...) may come late and repeatedly.

    A micro-batch is only appended, reduced to its last row of each key, under its own number, so one that runs twice replaces itself; each ``fold``-th folds all
    parts so far into one. Deleted keys stay as tombstones with their sequence number, so that a late older insert doesn't bring them back.
    """

    def apply(batch: DataFrame, number: int) -> None:
        latest(batch, [key], F.col(seq), F.col(deleted)).write.mode("overwrite").parquet(f"{path}/b={number}")
        if number % fold == fold - 1:
            fold_parts(batch.sparkSession, path, key, seq, deleted, number)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(the number of the last complete folded state, -1 if there is none; the numbers of the complete parts behind it)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in names if n[:2] in ("v=", "b=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    state = max((int(n[2:]) for n in done if n.startswith("v=")), default=-1)
    return state, sorted(int(n[2:]) for n in done if n.startswith("b=") and int(n[2:]) > state)


def fold_parts(spark: SparkSession, path: str, key: str, seq: str, deleted: str, number: int) -> None:
    """Write the state up to the part ``number`` as one, then delete what it replaces, but for the last state and its parts, which a reader may still use."""
    state, parts = _parts(spark, path)
    if number <= state:
        return
    paths = [f"{path}/v={state}"] * (state >= 0) + [f"{path}/b={b}" for b in parts if b <= number]
    latest(spark.read.parquet(*paths), [key], F.col(seq), F.col(deleted)).write.mode("overwrite").parquet(f"{path}/v={number}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if (name.startswith("b=") and int(name[2:]) <= state) or (name.startswith("v=") and int(name[2:]) < state):
            fs.delete(status.getPath(), True)


def current(spark: SparkSession, path: str, key: str, seq: str, deleted: str) -> DataFrame | None:
    """The state, tombstones included; None if there is none."""
    state, parts = _parts(spark, path)
    paths = [f"{path}/v={state}"] * (state >= 0) + [f"{path}/b={b}" for b in parts]
    return latest(spark.read.parquet(*paths), [key], F.col(seq), F.col(deleted)) if paths else None


class _Limiter:
    """The requests of one key in order of time."""

    def __init__(self, per_minute: int, most: int | None, times: Iterable[float] = (), ends: Iterable[float] = ()):
        self.per_minute, self.most, self.times, self.ends = per_minute, most, deque(times), list(ends)
        heapq.heapify(self.ends)

    def allows(self, t: float, end: float | None) -> bool:
        while self.times and t - self.times[0] >= 60:
            self.times.popleft()
        while self.ends and self.ends[0] <= t:
            heapq.heappop(self.ends)
        ok = len(self.times) < self.per_minute and (self.most is None or len(self.ends) < self.most)
        if ok:
            self.times.append(t)
            if self.most is not None and end is not None:
                heapq.heappush(self.ends, end)
        return ok


def limit_rate(feed: DataFrame, key: str, ts: str, per_minute: int, end: str | None = None, max_concurrent: int | None = None) -> DataFrame:
    """``key, ts, allowed``: a request is allowed if fewer than ``per_minute`` allowed ones lie in the 60 seconds before it, and, with ``max_concurrent``, fewer than that
    many allowed ones are still running, that is end (``end``, a timestamp; null ends at once) after it begins. Refused requests don't count.

    ``feed`` is a batch or a stream (rows of a key must come in order of time within a micro-batch sequence). A batch is sorted by key and time, and each task goes through
    its rows with the last minute of one key in hand, so no key has to fit in memory. Requests without a time are refused.
    """
    kind = f"{key} {feed.schema[key].dataType.simpleString()}, {ts} timestamp, allowed boolean"
    cols = [F.col(key), F.col(ts).cast("timestamp").alias(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("t_"), (F.unix_micros(F.col(end).cast("timestamp")) if end else F.lit(None).cast("bigint")).alias("end_")]
    rows = feed.select(*cols)
    schema = rows.select(key, ts, F.lit(True).alias("allowed")).schema

    def decide(limiter: _Limiter, times: list, ends: list) -> list[bool]:
        return [t is not None and limiter.allows(t / 1e6, None if e is None else e / 1e6) for t, e in zip(times, ends, strict=True)]

    if not feed.isStreaming:

        def walk(batches):
            of, limiter = object(), None
            for b in batches:
                allowed = []
                for k, t, e in zip(b[key].to_pylist(), b["t_"].to_pylist(), b["end_"].to_pylist(), strict=True):
                    if limiter is None or k != of:
                        of, limiter = k, _Limiter(per_minute, max_concurrent)
                    allowed += decide(limiter, [t], [e])
                yield pa.RecordBatch.from_arrays([b[key], b[ts], pa.array(allowed, pa.bool_())], names=[key, ts, "allowed"])

        return rows.repartition(key).sortWithinPartitions(key, "t_").mapInArrow(walk, schema)

    def step(_, frames: Iterator[pd.DataFrame], state):
        limiter = _Limiter(per_minute, max_concurrent, *(state.get if state.exists else ((), ())))
        pdf = pd.concat(list(frames)).sort_values("t_", kind="stable")
        none = lambda v: [None if pd.isna(x) else int(x) for x in v]
        out = pd.DataFrame({key: pdf[key], ts: pdf[ts], "allowed": decide(limiter, none(pdf["t_"]), none(pdf["end_"]))})
        state.update((list(limiter.times), limiter.ends))
        yield out

    return rows.groupBy(key).applyInPandasWithState(step, kind, "times array<double>, ends array<double>", "append", "NoTimeout")
