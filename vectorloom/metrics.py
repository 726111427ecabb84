"""Counters and latency histograms of a client's operations."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Upper bounds of the histogram's buckets in seconds; what is longer falls in a last one.
BOUNDS = (0.01, 0.1, 0.5, 1.0, 5.0, 30.0, 300.0)


class Metrics:
    """Kept on the driver, a row for each operation and collection; searches are lazy, so their time is that of planning."""

    def __init__(self):
        self.counts: dict[tuple[str, str], int] = defaultdict(int)
        self.seconds: dict[tuple[str, str], float] = defaultdict(float)
        self.buckets: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * (len(BOUNDS) + 1))

    def add(self, name: str, collection: str, n: int = 1) -> None:
        self.counts[name, collection] += n

    @contextmanager
    def timed(self, name: str, collection: str):
        """Count an operation and its time; one that fails counts as ``<name>_failed``."""
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.add(f"{name}_failed", collection)
            raise
        took = time.perf_counter() - began
        self.add(name, collection)
        self.seconds[name, collection] += took
        self.buckets[name, collection][bisect_left(BOUNDS, took)] += 1

    def frame(self, spark: SparkSession) -> DataFrame:
        """``name, collection, count, seconds, buckets`` of everything so far."""
        rows = [(n, c, k, self.seconds.get((n, c), 0.0), self.buckets[n, c] if (n, c) in self.buckets else None) for (n, c), k in sorted(self.counts.items())]
        return spark.createDataFrame(rows, "name string, collection string, count bigint, seconds double, buckets array<bigint>")
