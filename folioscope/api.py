"""The engine as an object: every entry point over one index, results as Python rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.callgraph import CallGraphProgram
from folioscope.config import EngineConfig
from folioscope.embedding import provider
from folioscope.functions import text as X
from folioscope.metrics import Metrics
from folioscope.operators import context, graph, index, read, search, vector_index


class Engine:
    """An index with its configuration, embedding provider and metrics.

    Methods that return a DataFrame are lazy; the others collect results that are bounded by a
    limit or belong to one document.
    """

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None, call_graph: CallGraphProgram | None = None) -> None:
        self.spark, self.config, self.store = spark, config or EngineConfig(), index.Store(spark, root)
        self.metrics, self.call_graph = Metrics(), call_graph
        self.embedder = provider(self.config.embedding)

    # tables
    @property
    def documents(self) -> DataFrame:
        return self.store.table("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.store.table("document_chunks")

    @property
    def sections(self) -> DataFrame:
        return self.store.table("document_sections")

    @property
    def symbols(self) -> DataFrame:
        return self.store.table("symbols")

    @property
    def edges(self) -> DataFrame:
        return self.store.table("relationships")

    # indexing
    def init(self) -> None:
        self.store.create()

    def index(self, root: str, **options) -> index.IndexResult:
        result = index.run_index(self.store, root, self.config, embedder=self.embedder, **options)
        self.metrics.record_indexing(**vars(result))
        return result

    def reindex(self, root: str, path: str, force: bool = True) -> index.IndexResult:
        return self.index(root, only=path, force=force)

    def delete(self, path: str) -> bool:
        return index.delete_path(self.store, path)

    def embed(self) -> int:
        if self.embedder is None:
            raise RuntimeError("no embedding provider is configured")
        return index.backfill_embeddings(self.store, self.embedder, self.config.embedding.batch_size)

    def build_vector_index(self, **options) -> int:
        """Inverted lists for semantic search; the number of lists that a search reads."""
        return self.store.build_vectors(self.config.embedding.dimension, **options)

    def _near(self, vector: list[float] | None) -> DataFrame | None:
        held = self.store.vectors() if vector else None
        return None if held is None or held[1].centroids.shape[1] != len(vector) else vector_index.candidates(*held, vector)

    def build_relationships(self, **options) -> int:
        return index.rebuild_edges(self.store, **options)

    # search
    def _vector(self, text: str) -> list[float] | None:
        return self.embedder([text])[0] if self.embedder is not None and text.strip() else None

    def search(self, query: search.SearchQuery | str, mode: str = "hybrid") -> DataFrame:
        """mode: text (or fts), semantic, hybrid; unknown modes are hybrid."""
        q = search.SearchQuery(query, self.config.search.default_limit) if isinstance(query, str) else query
        preview = min(X.PREVIEW, self.config.search.max_preview_length)
        if mode in ("text", "fts"):
            return search.text_search(self.chunks, self.documents, q, postings=self.store.postings(), preview=preview)
        if mode == "semantic":
            if self.embedder is None:
                raise RuntimeError("semantic search needs an embedding provider")
            vector = self._vector(q.text) or [0.0] * self.config.embedding.dimension
            return search.semantic_search(self.chunks, self.documents, q, vector, preview, self._near(vector))
        s, vector = self.config.search, self._vector(q.text)
        return search.hybrid_search(self.chunks, self.documents, q, vector, near=self._near(vector), weights=(s.fts_weight, s.semantic_weight), k=s.rrf_k, postings=self.store.postings(), preview=preview)

    def results(self, query: search.SearchQuery | str, mode: str = "hybrid") -> list[dict]:
        started = time.perf_counter()
        rows = [r.asDict(recursive=True) for r in self.search(query, mode).collect()]
        self.metrics.record_search(mode, (time.perf_counter() - started) * 1000)
        return rows

    # reading
    def read(self, request: read.ReadRequest) -> dict | None:
        """One document or a part of it.  Where lines or a symbol match no chunk and the file is
        there, its lines are read from disk."""
        row = read.read_document(self.chunks, self.symbols, self.documents, request).first()
        if row is None:
            return None
        out = row.asDict()
        if not out["content"] and (request.line_start is not None or request.symbol):
            import os

            if os.path.isfile(out["path"]):
                first, last = (1, None) if request.symbol else (request.line_start, request.line_end)
                out["content"] = read.read_lines_from_file(self.spark, out["path"], first, last).first()[0]
        return out

    def open(self, item_id: int, max_chars: int = 12_000) -> dict | None:
        row = read.open_by_id(self.chunks, self.documents, item_id, max_chars).first()
        return row.asDict() if row else None

    def outline(self, name: str) -> list[dict]:
        return [r.asDict() for r in read.outline(self.documents, self.sections, self.symbols, name).orderBy("part", "position", "label").collect()]

    def find(self, name: str, symbol_type: str | None = None, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in read.find_symbols(self.symbols, self.documents, name, symbol_type, limit).orderBy(F.length("name"), "name", "id").collect()]

    def list(self, **options) -> list[dict]:
        return [r.asDict() for r in read.list_documents(self.documents, **options).collect()]

    def document(self, doc_id: int) -> dict | None:
        row = read.with_children(self.documents, self.sections, self.chunks, self.symbols, F.col("doc_id") == doc_id).first()
        return row.asDict(recursive=True) if row else None

    def status(self) -> dict:
        rows = read.statistics(self.documents, self.sections, self.chunks, self.symbols, self.edges).collect()
        return {r["metric"]: r["value"] for r in rows} | {"metrics": self.metrics.snapshot()}

    # graph
    def _outside(self, kind: str) -> Callable[[str], DataFrame] | None:
        """Edges of the outside call graph, where there is one."""
        if self.call_graph is None or not self.call_graph.available():
            return None
        return lambda name: getattr(self.call_graph, kind)(self.spark, name)

    def related(self, name: str) -> list[dict]:
        return [r.asDict() for r in graph.related(self.edges, self.symbols, self.documents, name, self._outside("related")).orderBy("direction", "relationship_type", "neighbour_id").collect()]

    def references(self, name: str) -> list[dict]:
        return [r.asDict() for r in graph.references(self.edges, self.symbols, self.chunks, self.documents, name, self._outside("references")).orderBy("edge_id").collect()]

    # context
    def context(self, query: str, max_tokens: int = 4000, mode: str = "hybrid", extension: str | None = None, include_relationships: bool = True) -> dict:
        """A text of search excerpts, and edges of the best documents, within a budget."""
        top = self.search(search.SearchQuery(query, context.CANDIDATES, extension=extension), mode)
        found = top.select("chunk_id", "filename", "path", "section_title", "location", "score", "document_id").collect()
        if not found:
            return {"text": f"No relevant context found for '{query}'.", "chunks": 0, "tokens": 0}
        # The headings of the package, which callers look for.
        ranked = self.spark.createDataFrame([(k, *r) for k, r in enumerate(found, 1)], "rank int, chunk_id bigint, filename string, path string, section_title string, location string, score double, document_id bigint")
        head = f"# Context Package: {query}\nMode: {mode} | Search Matches: {len(found)}\n---\n"
        if include_relationships:
            first = ranked.groupBy("document_id").agg(F.min(F.struct("rank", "filename")).alias("m")).select(F.col("document_id").alias("doc_id"), "m.rank", "m.filename").orderBy("rank").limit(3)
            lines = [r["line"] for r in context.relationship_lines(self.edges, self.documents, first).orderBy("rank", F.desc("direction"), "position").collect()]
            if lines:
                head += "\n## Knowledge Graph Connections:\n" + "\n".join(dict.fromkeys(lines)) + "\n---\n"
        head += "\n## Relevant Excerpts:\n"
        budget = 4 * min(max_tokens, context.MAX_TOKENS)
        packed = context.pack(context.excerpts(ranked, self.chunks), budget, len(head)).orderBy("rank").collect()
        body = head + "".join(r["excerpt"] for r in packed)
        files = list(dict.fromkeys(r["filename"] for r in packed))
        note = f"<!-- {len(packed)} excerpts from {len(files)} documents -->\n"
        return {"text": note + body, "chunks": len(packed), "documents": files, "tokens": len(body) // 4}
