"""Latency and index-run metrics."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(calls: DataFrame) -> DataFrame:
    """``(tool, avg_ms, n, failures)`` of calls ``(tool, duration_ms, ok)``; averages have two
    digits, half to even."""
    return calls.groupBy("tool").agg(F.bround(F.avg("duration_ms"), 2).alias("avg_ms"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failures"))


class Metrics:
    """Counters of one process; safe to use from several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.runs = {"scanned": 0, "indexed": 0, "skipped": 0, "failed": 0, "deleted": 0, "chunks": 0, "duration_ms": 0}
        self.last_indexed: datetime | None = None
        self.searches: dict[str, list[float]] = defaultdict(list)
        self.calls: dict[str, list[float]] = defaultdict(list)
        self.failures: Counter = Counter()

    def record_indexing(self, **counts: int) -> None:
        with self._lock:
            for name, n in counts.items():
                self.runs[name] += n
            self.last_indexed = datetime.now(timezone.utc)

    def record_search(self, mode: str, milliseconds: float) -> None:
        with self._lock:
            self.searches[mode].append(milliseconds)

    def record_call(self, tool: str, milliseconds: float, ok: bool = True) -> None:
        with self._lock:
            self.calls[tool].append(milliseconds)
            self.failures[tool] += not ok

    def snapshot(self) -> dict:
        with self._lock:
            spent = [x for v in self.searches.values() for x in v]
            mean = lambda v: round(sum(v) / len(v), 2) if v else 0.0
            return {
                **self.runs,
                "last_indexed": self.last_indexed,
                "searches": {k: len(v) for k, v in self.searches.items()},
                "total_searches": len(spent),
                "average_search_ms": mean(spent),
                "calls": {k: {"count": len(v), "average_ms": mean(v), "failures": self.failures[k]} for k, v in self.calls.items()},
            }
