"""A directory as a stream of changes, and its application to an index.

The built-in file source never reports changed or removed files, so this is a streaming data
source of its own: each micro-batch is the difference of two listings (path, time, size).  A
difference is held back until the directory has been quiet for a while, so a burst of changes is
one batch.  The last listing is the stream's offset, kept beside the checkpoint as Parquet; the
directory and that state may lie on any file system that pyarrow knows by its URI.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from folioscope.config import EngineConfig
from folioscope.operators import index
from folioscope.streaming.changes import DELETE, UPSERT, coalesce, watchable

SCHEMA = "path string, op string, ts timestamp, seq bigint"
#: Changed paths of a batch that are read one by one; a batch of more is one run over the directory.
MOST_PATHS = 10_000
Listing = dict[str, tuple[int, int]]


def _place(uri: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def listing(root: str) -> Listing:
    """Path -> (time in ns, size) of all files under a directory."""
    from pyarrow import fs

    files, at = _place(root)
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    head = root.rstrip("/")[: -len(at.rstrip("/"))] if "://" in root and root.rstrip("/").endswith(at.rstrip("/")) else ""
    return {head + x.path: (x.mtime_ns or 0, x.size) for x in found if x.type == fs.FileType.File}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"] if "://" in options["path"] else os.path.abspath(options["path"])
        self.state = options.get("statedir") or f"{self.root.rstrip('/')}/.folioscope-watch"
        self.first = options.get("existing", "false").lower() == "true"
        self.quiet = int(options.get("quietms", "0")) / 1000
        #: What the directory looked like when it was last seen to change, and when that was.
        self.seen: Listing | None = None
        self.since = 0.0

    def _load(self, n: int) -> Listing:
        import pyarrow.parquet as pq

        files, at = _place(self.state)
        try:
            held = pq.read_table(f"{at}/{n}.parquet", filesystem=files).to_pydict()
        except FileNotFoundError:
            return {}
        return dict(zip(held["path"], zip(held["mtime"], held["size"])))

    def _save(self, n: int, held: Listing) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, at = _place(self.state)
        files.create_dir(at, recursive=True)
        columns = {"path": pa.array(list(held), pa.string()), "mtime": pa.array([v[0] for v in held.values()], pa.int64()), "size": pa.array([v[1] for v in held.values()], pa.int64())}
        pq.write_table(pa.table(columns), f"{at}/{n}.new", filesystem=files)
        files.move(f"{at}/{n}.new", f"{at}/{n}.parquet")

    def initialOffset(self) -> dict:
        self._save(0, {} if self.first else self._list())
        return {"n": 0}

    def _list(self) -> Listing:
        own = self.state.rstrip("/") + "/"
        return {p: v for p, v in listing(self.root).items() if not p.startswith(own)}

    def _changes(self, a: Listing, b: Listing, n: int) -> Iterator[tuple]:
        now = datetime.now(timezone.utc)
        gone = [(p, DELETE) for p in sorted(a.keys() - b.keys())]
        new = [(p, UPSERT) for p in sorted(b) if a.get(p) != b[p]]
        # Spark copies this iterator, so it is one over a list.
        return iter([(path, op, now, n * 1_000_000_000 + k) for k, (path, op) in enumerate(gone + new)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        before, now = self._load(n), self._list()
        if now != (before if self.seen is None else self.seen):
            self.seen, self.since = now, time.monotonic()
        if before == now or time.monotonic() - self.since < self.quiet:
            return iter([]), start
        self.seen = None
        self._save(n + 1, now)
        return self._changes(before, now, n + 1), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._changes(self._load(start["n"]), self._load(end["n"]), end["n"])

    def commit(self, end: dict) -> None:
        files, at = _place(self.state)
        for n in range(max(0, end["n"] - 20), max(0, end["n"] - 10)):
            try:
                files.delete_file(f"{at}/{n}.parquet")
            except FileNotFoundError:
                pass


class DirectoryChanges(DataSource):
    """``spark.readStream.format("directory_changes").load(root)``; options ``statedir`` (where
    listings are kept), ``existing`` (report files that are there at the start) and ``quietms`` (how
    long nothing must have changed before changes are reported)."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def changes(spark: SparkSession, root: str, state_dir: str, config: EngineConfig | None = None, existing: bool = False, quiet_ms: int = 0) -> DataFrame:
    """A stream ``(path, op, ts, seq)`` of the changes that count."""
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(DirectoryChanges)
    stream = spark.readStream.format("directory_changes").option("statedir", state_dir).option("existing", str(existing).lower()).option("quietms", str(quiet_ms)).load(root)
    return stream.where(watchable(F.col("path"), (config or EngineConfig()).indexing.ignore))


def apply_changes(store: index.Store, root: str, batch: DataFrame, config: EngineConfig | None = None, embedder: index.Embedder | None = None) -> index.IndexResult | None:
    """The last operation of each path of a batch, applied to the index.

    Only the changed paths are read, hashed and looked up, and only the buckets of their documents
    rewritten.  Content hashes make it idempotent, so a batch that is delivered again changes
    nothing.  A batch of more than ``MOST_PATHS`` is one incremental run over the directory.
    """
    paths = [r[0] for r in coalesce(batch).select("path").limit(MOST_PATHS + 1).collect()]
    if not paths:
        return None
    return index.run_index(store, root, config, embedder=embedder, only=paths if len(paths) <= MOST_PATHS else None)


def watch(store: index.Store, root: str, state_dir: str, config: EngineConfig | None = None, quiet_ms: int = 500, embedder: index.Embedder | None = None, on_batch: Callable | None = None, poll_ms: int = 100) -> StreamingQuery:
    """Start watching; stop with ``.stop()``.  Changes are applied when nothing has changed
    for ``quiet_ms``; each further change starts that anew."""

    def run(batch: DataFrame, _: int) -> None:
        result = apply_changes(store, root, batch, config, embedder)
        if on_batch is not None and result is not None:
            on_batch(result)

    state = state_dir.rstrip("/")
    stream = changes(store.spark, root, f"{state}/listings", config, quiet_ms=quiet_ms)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=f"{poll_ms} milliseconds").start()
