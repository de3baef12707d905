"""The index: tables under a root, incremental runs, deletes, embeddings.

Tables are Parquet in buckets of documents.  The last bits of every id are those of its document's,
so one expression tells the bucket of a document, its parts and the edges that start at them.  A
change rewrites the buckets that it touches into new folders and then commits a manifest that names
the folder of each bucket, so readers never see a half-written state and a failed or repeated run
leaves the last one intact.  Ids are stable hashes of the path (and position), so edges stay valid
when a file is indexed again.

Beside the tables lie postings for full-text search, in buckets of terms.  A run appends those of the
documents that it indexed; postings carry the version of their document, so stale ones are told by
that until they are merged.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.cluster import materialise, spread
from folioscope.config import EngineConfig
from folioscope.functions import text as X
from folioscope.operators import chunking, graph, search, vector_index
from folioscope.operators.filters import distinct_chunks, unembedded
from folioscope.sources import scan as source

Embedder = Callable[[list[str]], list[list[float] | None]]


def classify(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """``(path, status)`` of paths with hashes: new, changed, unchanged, deleted."""
    a, b = scanned.select("path", F.col("hash").alias("_new")), stored.select("path", F.col("hash").alias("_old"))
    both = a.withColumn("_in", F.lit(True)).join(b.withColumn("_was", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("_in").isNull(), "deleted").when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"))


#: Buckets of a new index, a power of two; and the bits that all ids of a document share.
BUCKETS = 64
SHARED_BITS = 12
#: Segments of postings beyond which they are merged.
MOST_SEGMENTS = 16
#: The id that tells the bucket of a table's rows.
OWNER = {"documents": "doc_id", "document_sections": "document_id", "document_chunks": "document_id", "symbols": "document_id", "relationships": "source_id"}


class Store:
    """The five tables under a folder, and their postings."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        if buckets & (buckets - 1) or not 1 <= buckets <= 1 << SHARED_BITS:
            raise ValueError(f"buckets must be a power of two up to {1 << SHARED_BITS}")
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def create(self) -> None:
        """M7: empty tables, unless there are some."""
        if self.generation() is None:
            self._commit({"buckets": self._buckets, "tables": {name: {} for name in schemas.TABLES}, "postings": []}, 1)

    def generation(self) -> int | None:
        """The newest committed generation."""
        done = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        return max(done, default=None)

    def manifest(self, generation: int | None = None) -> dict:
        at = self.generation() if generation is None else generation
        if at is None:
            raise FileNotFoundError(f"no index in {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/manifest-{at}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, generation: int) -> None:
        """Written whole under another name first; the renaming is what commits it."""
        new = self._path(f"{self.root}/manifest-{generation}.json.new")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(new, self._path(f"{self.root}/manifest-{generation}.json")):
            raise OSError(f"generation {generation} was committed by another writer")

    @property
    def buckets(self) -> int:
        return self.manifest()["buckets"] if self.generation() is not None else self._buckets

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.buckets)).cast("int")

    def _parquet(self, schema, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or its given buckets."""
        held = self.manifest()["tables"][name]
        return self._parquet(schemas.TABLES[name], [f for b, f in sorted(held.items()) if buckets is None or int(b) in buckets])

    def postings(self) -> DataFrame:
        """All segments, each of which is partitioned by ``bucket``."""
        segments = [self._parquet(schemas.POSTINGS, [x]) for x in self.manifest()["postings"]]
        return reduce(DataFrame.unionByName, segments) if segments else self._parquet(schemas.POSTINGS, [])

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of ids in one-column frames."""
        ids = None
        for k in keys:
            k = k.toDF("k")
            ids = k if ids is None else ids.unionByName(k)
        return sorted(r[0] for r in ids.select(self.bucket_of(F.col("k")).alias("b")).distinct().collect())

    def _written(self, rows: DataFrame, name: str, generation: int) -> dict[str, str]:
        """Write rows by their column ``bucket``; bucket -> folder of those that have rows."""
        folder = f"{name}-{generation}-{uuid.uuid4().hex[:8]}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(f"{self.root}/data/{folder}") if n.startswith("bucket=")}

    def write(self, changed: dict[str, DataFrame], touched: dict[str, list[int]] | None = None, fresh_postings: DataFrame | None = None, fresh_vectors: tuple[DataFrame, DataFrame] | None = None, keep: int = 2) -> int:
        """A new generation.  ``changed``: all rows of the tables' ``touched`` buckets (of all buckets
        where a table isn't in ``touched``); other buckets stay as they are.  ``fresh_vectors``: chunks and
        documents that go to the inverted lists, if there are any.  The last ``keep``
        generations stay for running readers."""
        self.create()
        old = self.generation()
        new, manifest = old + 1, self.manifest(old)
        for name, rows in changed.items():
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]]
            keyed = rows.select(*columns).withColumn("bucket", F.pmod(F.col(OWNER[name]), F.lit(manifest["buckets"])).cast("int"))
            kept = {} if touched is None or name not in touched else {b: f for b, f in manifest["tables"][name].items() if int(b) not in touched[name]}
            manifest["tables"][name] = {**kept, **self._written(keyed, name, new)}
        if fresh_postings is not None:
            if self._written(fresh_postings.sortWithinPartitions("term", "chunk_id"), "postings", new):
                manifest["postings"].append(next(n for n in self._names(f"{self.root}/data") if n.startswith(f"postings-{new}-")))
        if fresh_vectors is not None and manifest.get("vectors"):
            held = manifest["vectors"]
            folder = f"vectors-{new}-{uuid.uuid4().hex[:8]}"
            rows = vector_index.assigned(self._vector_rows(*fresh_vectors), vector_index.Lists(np.array(held["centroids"]), held["probes"]))
            rows.coalesce(1).write.partitionBy("list").parquet(f"{self.root}/data/{folder}")
            if any(n.startswith("list=") for n in self._names(f"{self.root}/data/{folder}")):
                held["segments"].append(folder)
        self._commit(manifest, new)
        self._clear(new, keep)
        return new

    def _clear(self, new: int, keep: int) -> None:
        """Delete old manifests and the folders that no kept one names."""
        for n in self._names(self.root):
            if n.startswith("manifest-") and n.endswith(".json") and int(n[9:-5]) <= new - keep:
                self._fs.delete(self._path(f"{self.root}/{n}"), False)
        used = set()
        for at in range(max(1, new - keep + 1), new + 1):
            if self._fs.exists(self._path(f"{self.root}/manifest-{at}.json")):
                m = self.manifest(at)
                used |= {f for t in m["tables"].values() for f in t.values()} | set(m["postings"]) | set((m.get("vectors") or {}).get("segments", []))
        for folder in self._names(f"{self.root}/data"):
            if folder in used:
                continue
            parts = [n for n in self._names(f"{self.root}/data/{folder}") if n.startswith("bucket=")]
            live = [n for n in parts if f"{folder}/{n}" in used]
            for n in parts if live else []:
                if n not in live:
                    self._fs.delete(self._path(f"{self.root}/data/{folder}/{n}"), True)
            if not live:
                self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)

    def merge_postings(self, most: int = MOST_SEGMENTS) -> None:
        """Segments of postings as one, without stale ones, if there are more than ``most``."""
        manifest = self.manifest()
        if len(manifest["postings"]) <= most:
            return
        live = self.table("documents").select(F.col("doc_id").alias("document_id"), search.version_of(F.col("hash")).alias("version"))
        rows = self.postings().join(live, ["document_id", "version"], "left_semi").select(*schemas.POSTINGS.fieldNames())
        new = self.generation() + 1
        self._written(rows.repartition("bucket").sortWithinPartitions("bucket", "term", "chunk_id"), "postings", new)
        manifest["postings"] = [n for n in self._names(f"{self.root}/data") if n.startswith(f"postings-{new}-")]
        self._commit(manifest, new)
        self._clear(new, 2)

    def vectors(self) -> tuple[DataFrame, vector_index.Lists] | None:
        """Inverted lists of the embeddings, if they were built: rows in segments, and centroids."""
        held = self.manifest().get("vectors")
        if not held:
            return None
        segments = [self.spark.read.schema(vector_index.ROWS).parquet(f"{self.root}/data/{x}") for x in held["segments"]]
        return reduce(DataFrame.unionByName, segments), vector_index.Lists(np.array(held["centroids"]), held["probes"])

    def _vector_rows(self, chunks: DataFrame, documents: DataFrame) -> DataFrame:
        versions = documents.select(F.col("doc_id").alias("document_id"), search.version_of(F.col("hash")).alias("version"))
        return chunks.select(F.col("id").alias("chunk_id"), "document_id", "embedding").join(versions, "document_id")

    def build_vectors(self, dimension: int, lists: int = vector_index.LISTS) -> int:
        """(Re)build the inverted lists over all embeddings of a dimension; the lists a search reads."""
        self.create()
        rows = self._vector_rows(self.table("document_chunks"), self.table("documents"))
        found = vector_index.fit(rows, dimension, lists)
        manifest, new = self.manifest(), self.generation() + 1
        folder = f"vectors-{new}-{uuid.uuid4().hex[:8]}"
        vector_index.assigned(rows, found).hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.root}/data/{folder}")
        manifest["vectors"] = {"segments": [folder], "centroids": found.centroids.tolist(), "probes": found.probes}
        self._commit(manifest, new)
        self._clear(new, 2)
        return found.probes

    def by_path(self, path: str) -> DataFrame:
        return self.table("documents").where(F.col("path") == path)

    def path_hashes(self) -> DataFrame:
        return self.table("documents").select("path", "hash")


def parsed_files(files: DataFrame, normalise_types: bool = False) -> DataFrame:
    """``(path, ..., parsed, chunks)``: files of :func:`folioscope.sources.scan.scan` parsed and
    chunked in one Python stage; a file that can't be read has ``parsed.error`` set."""
    chunk = schemas.CHUNK.simpleString()
    schema = f"path string, extension string, size bigint, modified_at timestamp, hash string, parsed {schemas.PARSED.simpleString()}, chunks array<{chunk}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from folioscope.sources.parsers import parse

        for batch in batches:
            parsed = [parse(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])]
            chunks = [[] if x["error"] else chunking.chunk_parsed(x, normalise_types=normalise_types) for x in parsed]
            yield batch.drop(columns=["content"]).assign(parsed=parsed, chunks=chunks)

    return files.mapInPandas(run, schema)


def _key(*parts) -> Column:
    """A non-negative 63-bit id from a path and a position; the last bits are the path's alone."""
    shared, own = F.lit((1 << SHARED_BITS) - 1), F.lit((1 << 63) - (1 << SHARED_BITS))
    return F.xxhash64(*parts).bitwiseAND(own).bitwiseOR(F.xxhash64(parts[0]).bitwiseAND(shared))


def _edge_key(*parts) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def index_rows(parsed: DataFrame, indexed_at: datetime, sanitise: bool = True) -> dict[str, DataFrame]:
    """Rows of the document, section, chunk and symbol tables of parsed files without error;
    ``sanitise`` removes control characters from texts."""
    clean = X.sanitise if sanitise else lambda t: F.coalesce(t, F.lit(""))
    ok = parsed.where("parsed.error is null").withColumn("doc", _key(F.col("path")))
    none = lambda kind: F.lit(None).cast(kind)
    empty = lambda m: F.when(F.size(m) > 0, m)
    documents = ok.select(
        F.col("doc").alias("doc_id"), F.array_join(F.transform("parsed.sections", lambda s: clean(s["content"])), "\n\n").alias("text"), "path", X.basename(F.col("path")).alias("filename"), "extension",
        none("string").alias("mime_type"), F.col("parsed.title").alias("title"), F.col("parsed.document_type").alias("document_type"), "size", "hash", "modified_at",
        F.lit(indexed_at).cast("timestamp").alias("indexed_at"), none("string").alias("parser"), F.col("parsed.language").alias("language"), empty(F.col("parsed.metadata")).alias("metadata"),
    )
    s = ok.select("path", "doc", F.posexplode("parsed.sections").alias("i", "s"))
    sections = s.select(_key(F.col("path"), F.lit("section"), F.col("i")).alias("id"), F.col("doc").alias("document_id"), none("bigint").alias("parent_id"), F.col("i").alias("section_index"), "s.title", "s.page_number", "s.slide_number", "s.sheet_name", "s.depth", empty(F.col("s.metadata")).alias("metadata"))
    c = ok.select("path", "doc", F.posexplode("chunks").alias("i", "c"))
    chunks = c.select(
        _key(F.col("path"), F.lit("chunk"), F.col("i")).alias("id"), F.col("doc").alias("document_id"), none("bigint").alias("section_id"), F.col("i").alias("chunk_index"), clean(F.col("c.content")).alias("content"),
        "c.token_count", "c.page_number", "c.slide_number", "c.sheet_name", "c.line_start", "c.line_end", "c.section_title", none("array<float>").alias("embedding"), empty(F.col("c.metadata")).alias("metadata"),
    )
    y = ok.select("path", "doc", F.posexplode("parsed.symbols").alias("i", "y"))
    above = F.when(F.col("y.parent").isNotNull(), _key(F.col("path"), F.lit("symbol"), F.col("y.parent")))
    symbols = y.select(_key(F.col("path"), F.lit("symbol"), F.col("i")).alias("id"), F.col("doc").alias("document_id"), "y.name", F.col("y.kind").alias("symbol_type"), "y.namespace", above.alias("parent_symbol_id"), "y.line_start", "y.line_end", "y.signature", none("map<string,string>").alias("metadata"))
    return {"documents": documents, "document_sections": sections, "document_chunks": chunks, "symbols": symbols}


@dataclass
class IndexResult:
    scanned: int = 0
    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    deleted: int = 0
    chunks: int = 0
    duration_ms: int = 0


def _without(store: Store, gone: DataFrame, extra: list[int] = []) -> tuple[dict[str, DataFrame], dict[str, list[int]]]:  # noqa: B006
    """The touched buckets (those of ``gone (doc_id)``, and ``extra``) without the documents of
    ``gone``, their children, and edges at them; and which buckets those are, by table."""
    key = materialise(gone.select("doc_id").distinct(), "gone")
    own = sorted({*store.touched(key), *extra})
    out = {"documents": store.table("documents", own).join(key, "doc_id", "left_anti")}
    lost = key.select(F.lit("Document").alias("t"), F.col("doc_id").alias("i"))
    for name, kind in (("document_sections", "Section"), ("document_chunks", "Chunk"), ("symbols", "Symbol")):
        rows = store.table(name, own)
        of = key.select(F.col("doc_id").alias("document_id"))
        out[name] = rows.join(of, "document_id", "left_anti")
        lost = lost.unionByName(rows.join(of, "document_id", "left_semi").select(F.lit(kind).alias("t"), F.col("id").alias("i")))
    lost = materialise(lost.distinct(), "lost")
    at = lambda end: lost.select(F.col("t").alias(f"{end}_type"), F.col("i").alias(f"{end}_id"))
    # Edges that start at what is lost lie in its buckets; those that lead there may lie in any.
    into = store.table("relationships").select("source_id", "target_type", "target_id").join(at("target"), ["target_type", "target_id"], "left_semi")
    touched = sorted({*own, *store.touched(into.select("source_id"))})
    edges = store.table("relationships", touched)
    for end in ("source", "target"):
        edges = edges.join(at(end), [f"{end}_type", f"{end}_id"], "left_anti")
    out["relationships"] = edges
    return out, {**dict.fromkeys(out, own), "relationships": touched}


def run_index(store: Store, root: str, config: EngineConfig | None = None, prune_outside_root: bool = False, force: bool = False, normalise_types: bool = False, embedder: Embedder | None = None, only: str | list[str] | None = None) -> IndexResult:
    """M3: bring the index up to date with a directory.

    New and changed files (by content hash) are parsed, unchanged ones skipped, and documents
    under the root whose file is gone removed; ``prune_outside_root`` removes all others too.
    ``only`` restricts the run to one path (M4) or a few, of those under the root: no other file is
    read or hashed.  ``force``
    parses unchanged files as well.  A file that can't be parsed counts as failed and leaves its
    stored document as it was.  Only the buckets of documents that change are rewritten.
    """
    began = time.perf_counter()
    config = config or EngineConfig()
    store.create()
    under = (root if "://" in root else source.os.path.abspath(root)).rstrip("/") + "/"
    paths = None if only is None else [p for p in ([only] if isinstance(only, str) else only) if p.startswith(under)]
    files = source.scan(store.spark, root, config.indexing, config.security, paths=paths)
    stored = store.table("documents").select("path", "hash", "doc_id")
    if paths is not None:
        stored = stored.where(F.col("path").isin(paths))
    elif not prune_outside_root:
        stored = stored.where(F.col("path").startswith(under))
    status = materialise(classify(files.select("path", "hash"), stored), "status")
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = IndexResult(scanned=sum(n for s, n in counts.items() if s != "deleted"), deleted=counts.get("deleted", 0), skipped=0 if force else counts.get("unchanged", 0))
    todo = status.where(F.col("status").isin("new", "changed", *(["unchanged"] if force else []))).select("path")
    # Parsing is what takes time, so a few files are spread over at least so many tasks.
    wanted = spread(files, "path", least=config.indexing.max_parallelism).join(todo, "path", "left_semi")
    parsed = materialise(parsed_files(wanted, normalise_types), "parsed")
    seen = parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parsed.error").isNotNull()).alias("bad"), F.sum(F.when(F.col("parsed.error").isNull(), F.size("chunks"))).alias("chunks")).first()
    result.failed, result.indexed, result.chunks = seen["bad"], seen["n"] - seen["bad"], seen["chunks"] or 0
    if result.indexed or result.deleted:
        fresh = index_rows(parsed, datetime.now(timezone.utc).replace(tzinfo=None), config.security.sanitize_content)
        if embedder is not None:
            fresh["document_chunks"] = embed_missing(fresh["document_chunks"], embedder, config.embedding.batch_size)
        done = parsed.where("parsed.error is null").select("path").unionByName(status.where("status = 'deleted'").select("path"))
        rest, touched = _without(store, stored.join(done, "path", "left_semi"), store.touched(fresh["documents"].select("doc_id")))
        rows = {name: rest[name].unionByName(fresh[name]) if name in fresh else rest[name] for name in rest}
        store.write(rows, touched, fresh_postings(fresh) if result.indexed else None, (fresh["document_chunks"], fresh["documents"]) if result.indexed else None)
        store.merge_postings()
        if len((store.manifest().get("vectors") or {}).get("segments", [])) > MOST_SEGMENTS:
            store.build_vectors(config.embedding.dimension)
    result.duration_ms = round(1000 * (time.perf_counter() - began))
    return result


def fresh_postings(fresh: dict[str, DataFrame]) -> DataFrame:
    """Rows of ``schemas.POSTINGS`` of the chunks of :func:`index_rows`."""
    versions = fresh["documents"].select(F.col("doc_id").alias("document_id"), search.version_of(F.col("hash")).alias("version"))
    rows = search.build_postings(fresh["document_chunks"]).join(versions, "document_id")
    return rows.withColumn("bucket", search.term_bucket(F.col("term"))).select(*schemas.POSTINGS.fieldNames())


def delete_path(store: Store, path: str) -> bool:
    """M2: a document, its children and the edges at them."""
    gone = store.by_path(path).select("doc_id")
    if gone.isEmpty():
        return False
    store.write(*_without(store, gone))
    return True


def embed_missing(chunks: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """M5, M8: chunks with an embedding where they had none and aren't blank, in the order of their
    ids within a task, ``batch`` contents a call.  A batch whose embedding fails keeps null; vectors
    that are not finite count as failed."""
    schema = chunks.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            todo = part.index[part["embedding"].isna() & part["content"].fillna("").str.strip().ne("")].tolist()
            held = part["embedding"].tolist()
            place = {label: k for k, label in enumerate(part.index)}
            for at in range(0, len(todo), batch):
                ids = todo[at : at + batch]
                try:
                    vectors = embedder([part.at[i, "content"] for i in ids])
                except Exception:  # noqa: BLE001 - a provider's failure must not lose the chunk
                    vectors = [None] * len(ids)
                for i, v in zip(ids, vectors):
                    held[place[i]] = [float(x) for x in v] if v is not None and all(x == x and abs(x) != float("inf") for x in v) else None
            part = part.copy()
            part["embedding"] = pd.Series(held, index=part.index, dtype=object)
            part["metadata"] = part["metadata"].map(lambda m: dict(m) if m is not None else None)
            yield part

    return chunks.sortWithinPartitions("id").mapInPandas(run, schema)


def backfill_embeddings(store: Store, embedder: Embedder, batch: int = 32) -> int:
    """M5 on the stored index; the number of chunks that were without.  Only their buckets are
    rewritten."""
    todo = distinct_chunks(store.table("document_chunks").where(unembedded()).select("id", "document_id"))
    found = todo.groupBy(store.bucket_of(F.col("document_id")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    if found:
        buckets = [r["b"] for r in found]
        missing = materialise(store.table("document_chunks", buckets).where(unembedded()).select("id"), "missing")
        new = materialise(embed_missing(store.table("document_chunks", buckets), embedder, batch), "embedded")
        store.write({"document_chunks": new}, {"document_chunks": buckets}, fresh_vectors=(new.join(missing, "id", "left_semi"), store.table("documents", buckets)))
    return sum(r["n"] for r in found)


def rebuild_edges(store: Store, parents: bool = False, max_symbols: int | None = None) -> int:
    """All edges anew, with ids from their content, so building twice gives the same."""
    t = store.table
    edges = graph.build_all(t("documents"), t("document_sections"), t("document_chunks"), t("symbols"), parents, max_symbols)
    keyed = edges.withColumn("id", _edge_key("source_type", "source_id", "target_type", "target_id", "relationship_type"))
    store.write({"relationships": keyed})
    return store.table("relationships").count()
