"""Coalescing and debouncing of file changes (T2 to T4), for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPSERT, DELETE = "UPSERT", "DELETE"


def watchable(path: Column, ignore: list[str]) -> Column:
    """Whether a change of the path counts: no ignored directory in it, and no temporary file."""
    parts = F.split(F.lower(path), r"[/\\]")
    name = F.element_at(parts, -1)
    ignored = F.arrays_overlap(parts, F.array(*(F.lit(x.lower()) for x in ignore))) if ignore else F.lit(False)
    return ~ignored & ~name.startswith("~$") & ~name.startswith(".#") & ~name.endswith(".tmp")


def coalesce(events: DataFrame) -> DataFrame:
    """The last operation of each path ``(path, op, ts)``; of equal times the one with the larger
    ``seq``.  Resolving to one operation also settles the order of a delete and a re-creation."""
    last = F.max_by(F.struct("op", "ts"), F.struct("ts", "seq"))
    return events.groupBy("path").agg(last.alias("_l")).select("path", F.col("_l.op").alias("op"), F.col("_l.ts").alias("ts"))


def debounce_sessions(events: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """Bursts of a path: a burst ends when nothing happens for ``quiet``.  ``(path, first_ts,
    last_ts, n)``; runs on a stream with a watermark as well."""
    burst = F.session_window("ts", quiet)
    return events.groupBy("path", burst).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).select("path", "first_ts", "last_ts", "n")
