"""The registered queries of the engine's own operators, each with the SQL it must equal.

Queries run over whole tables.  Where a ``LIMIT`` appears it is the operator's own (top-k search,
paging).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import read_table
from folioscope.functions import text as X
from folioscope.operators import chunking, context, filters, graph, read, search
from folioscope.plans import sql as S
from folioscope.sources.scan import content_hash

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a data directory, by name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        names = {"chunks": "document_chunks", "sections": "document_sections", "edges": "relationships"}
        return read_table(self.spark, self.root, names.get(name, name))


def _query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, root: f(Tables(spark, root))
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


# --- filters -----------------------------------------------------------------------------------


@_query("f1_doc_type", "SELECT doc_id, path, document_type FROM documents WHERE document_type = 'pdf'")
def _(t: Tables) -> DataFrame:
    return t.documents.where(filters.document_filter(document_type="pdf")).select("doc_id", "path", "document_type")


@_query("f2_extension", "SELECT doc_id, extension FROM documents WHERE extension = '.md'")
def _(t: Tables) -> DataFrame:
    return t.documents.where(filters.document_filter(extension="md")).select("doc_id", "extension")


@_query("f3_path_prefix", "SELECT doc_id, path FROM documents WHERE starts_with(path, '/data/vol00/harborlight/')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(filters.document_filter(path_prefix="/data/vol00/harborlight/")).select("doc_id", "path")


@_query("f5_has_embedding", "SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE embedding IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.embedded()).select(F.col("id").alias("chunk_id")).distinct()


@_query("f6_ilike_find", "SELECT id, name FROM symbols WHERE name ILIKE '%parser%'")
def _(t: Tables) -> DataFrame:
    return t.symbols.where(X.contains_ci(F.col("name"), "parser")).select("id", "name")


@_query("f7_sheet_equal", "SELECT DISTINCT id AS chunk_id, sheet_name FROM document_chunks WHERE lower(sheet_name) = 'sheet1'")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.on_sheet("Sheet1")).select(F.col("id").alias("chunk_id"), "sheet_name").distinct()


@_query("f8_page_equal", "SELECT DISTINCT id AS chunk_id, page_number FROM document_chunks WHERE page_number = 2")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.on_page(2)).select(F.col("id").alias("chunk_id"), "page_number").distinct()


@_query("f9_line_overlap", "SELECT DISTINCT id AS chunk_id, line_start, line_end FROM document_chunks WHERE line_start <= 60 AND line_end >= 40")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.overlaps_lines(40, 60)).select(F.col("id").alias("chunk_id"), "line_start", "line_end").distinct()


@_query("f10_unembedded", r"SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE embedding IS NULL AND regexp_matches(content, '[^\s\p{Z}]')")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.unembedded()).select(F.col("id").alias("chunk_id")).distinct()


@_query("f11_id_in_list", "SELECT DISTINCT id AS chunk_id, chunk_index FROM document_chunks WHERE id IN (SELECT source_id FROM relationships WHERE source_type = 'Chunk')")
def _(t: Tables) -> DataFrame:
    wanted = t.edges.where("source_type = 'Chunk'").select("source_id")
    return filters.with_ids(t.chunks.select("id", "chunk_index"), wanted).select(F.col("id").alias("chunk_id"), "chunk_index").distinct()


@_query("f12_incident_edges", """SELECT id, direction, relationship_type FROM (SELECT id, relationship_type, CASE WHEN source_id = 7 AND source_type = 'Document' THEN 'outgoing' ELSE 'incoming' END AS direction
  FROM relationships WHERE (source_id = 7 AND source_type = 'Document') OR (target_id = 7 AND target_type = 'Document'))""")
def _(t: Tables) -> DataFrame:
    return graph.incident_edges(t.edges, 7, "Document").select("id", "direction", "relationship_type")


@_query("f13_reference_edges", "SELECT id, source_id, target_id FROM relationships WHERE relationship_type IN ('REFERENCES', 'MENTIONS', 'CALLS') AND target_type = 'Symbol'")
def _(t: Tables) -> DataFrame:
    return t.edges.where(filters.references_to_symbols()).select("id", "source_id", "target_id")


@_query("f15_contains", "SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE contains(content, 'Shipment')")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(filters.named("content", "Shipment")).select(F.col("id").alias("chunk_id")).distinct()


# --- functions ---------------------------------------------------------------------------------


@_query("s6_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_hash(F.col("text").cast("binary")).alias("content_hash"))


@_query("k1_token_estimate", f"SELECT id AS chunk_id, CAST(ceil(length(content) / 4.0) AS INTEGER) AS tokens FROM {S.CHUNKS}")
def _(t: Tables) -> DataFrame:
    return t.chunks.select(F.col("id").alias("chunk_id"), X.token_estimate(F.col("content")).alias("tokens")).dropDuplicates(["chunk_id"])


@_query("k7_sanitise", r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS clean_md5 FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.sanitise(F.col("text")).cast("binary")).alias("clean_md5"))


@_query("k3_split_parts", r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\r\n\r\n|\n\n'), lambda x: x <> '')) AS BIGINT) AS paragraphs,
  CAST(len(list_filter(regexp_split_to_array(text, '\r\n|\n|\. '), lambda x: x <> '')) AS BIGINT) AS parts FROM documents WHERE text IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(chunking.paragraphs(F.col("text"))).cast("bigint").alias("paragraphs"), F.size(chunking.sentences(F.col("text"))).cast("bigint").alias("parts"))


@_query("k5_fallback_chunks", r"SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_count, md5(text) AS content_md5 FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')")
def _(t: Tables) -> DataFrame:
    return chunking.fallback_chunks(t.documents.select("doc_id", "text")).select("doc_id", "token_count", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_STRIP = r"regexp_replace({0}, '^[\s\x0B\x{{85}}\p{{Z}}\x1C-\x1F]+|[\s\x0B\x{{85}}\p{{Z}}\x1C-\x1F]+$', '', 'g')"
_GREEDY = rf"""
WITH t AS (SELECT doc_id, {_STRIP.format("text")} AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, flatten(list_transform(list_filter(regexp_split_to_array(t, '\r\n\r\n|\n\n'), lambda p: p <> ''), lambda p: CASE WHEN ceil(length(p) / 4.0) <= 512 THEN [{{'piece': p, 'joint': chr(10) || chr(10)}}]
  ELSE list_transform(list_filter(regexp_split_to_array(p, '\r\n|\n|\. '), lambda x: x <> ''), lambda x: {{'piece': x, 'joint': '. '}}) END)) AS atoms FROM t WHERE length(t) > 2048),
f AS (SELECT doc_id, list_reduce(atoms, lambda s, x: CASE WHEN s.total > 0 AND s.total + ceil(length(x.piece) / 4.0) > 512
    THEN {{'done': list_append(s.done, {{'content': s.held, 'n': s.total}}), 'held': x.piece, 'total': CAST(ceil(length(x.piece) / 4.0) AS BIGINT)}}
    ELSE {{'done': s.done, 'held': s.held || CASE WHEN s.held <> '' THEN x.joint ELSE '' END || x.piece, 'total': s.total + CAST(ceil(length(x.piece) / 4.0) AS BIGINT)}} END,
  {{'done': CAST([] AS STRUCT(content VARCHAR, n BIGINT)[]), 'held': '', 'total': CAST(0 AS BIGINT)}}) AS s FROM a),
o AS (SELECT doc_id, list_append(s.done, {{'content': s.held, 'n': s.total}}) AS c FROM f WHERE s.held <> '' UNION ALL SELECT doc_id, [{{'content': t, 'n': CAST(ceil(length(t) / 4.0) AS BIGINT)}}] FROM t WHERE length(t) BETWEEN 1 AND 2048)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, {_STRIP.format("c[i].content")} AS content, CAST(c[i].n AS INTEGER) AS token_count FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM o)"""


@_query("k3_greedy_chunks", _GREEDY)
def _(t: Tables) -> DataFrame:
    return chunking.greedy_chunks(t.documents.select("doc_id", "text"))


@_query("x7_preview", f"""SELECT chunk_id, CASE WHEN length(p) > 160 THEN substr(p, 1, 157) || '...' ELSE p END AS preview
  FROM (SELECT id AS chunk_id, {S.TRIM.format("translate(coalesce(content, ''), chr(13) || chr(10), '  ')")} AS p FROM {S.CHUNKS})""")
def _(t: Tables) -> DataFrame:
    return t.chunks.select(F.col("id").alias("chunk_id"), X.preview(F.col("content")).alias("preview")).dropDuplicates(["chunk_id"])


@_query("x8_location", f"SELECT id AS chunk_id, {S.LOCATION} AS location FROM {S.CHUNKS}")
def _(t: Tables) -> DataFrame:
    return t.chunks.select(F.col("id").alias("chunk_id"), X.location(*(F.col(c) for c in search.PLACE)).alias("location")).dropDuplicates(["chunk_id"])


@_query("x10_half_even", "SELECT id, round_even(confidence::DOUBLE, 1) AS rounded FROM relationships")
def _(t: Tables) -> DataFrame:
    return t.edges.select("id", X.half_even(F.col("confidence").cast("double"), 1).alias("rounded"))


@_query("x11_truncate", "SELECT doc_id, CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || '[cut]' ELSE text END AS shown FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate(F.col("text"), 12_000, "[cut]").alias("shown"))


@_query("x12_dotted_extension", "SELECT doc_id, CASE WHEN extension IS NULL OR extension = '' OR starts_with(extension, '.') THEN lower(extension) ELSE '.' || lower(extension) END AS ext FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.dotted_lower(F.col("extension")).alias("ext"))


@_query("x13_path_parts", r"""SELECT doc_id, regexp_extract(path, '([^/\\]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem,
  lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) AS ext FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.basename(F.col("path")).alias("base"), X.stem(F.col("path")).alias("stem"), X.extension_of(F.col("path")).alias("ext"))


# --- joins -------------------------------------------------------------------------------------


@_query("j1_chunk_doc", f"SELECT c.id AS chunk_id, d.path, d.document_type FROM (SELECT DISTINCT id, document_id FROM document_chunks) c JOIN documents d ON d.doc_id = c.document_id")
def _(t: Tables) -> DataFrame:
    ids = filters.distinct_chunks(t.chunks.select("id", "document_id"))
    return ids.join(t.documents, ids.document_id == F.col("doc_id")).select(F.col("id").alias("chunk_id"), "path", "document_type")


@_query("j2_symbol_doc", "SELECT s.id, s.name, d.path FROM symbols s LEFT JOIN documents d ON d.doc_id = s.document_id")
def _(t: Tables) -> DataFrame:
    return read.with_paths(t.symbols.select("id", "name", "document_id"), t.documents).select("id", "name", "path")


@_query("j3_children", """SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_sections, CAST(coalesce(c.n, 0) AS BIGINT) AS n_chunks, CAST(coalesce(y.n, 0) AS BIGINT) AS n_symbols FROM documents d
  LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n FROM document_sections GROUP BY 1) s ON s.document_id = d.doc_id
  LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n FROM document_chunks GROUP BY 1) c ON c.document_id = d.doc_id
  LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n FROM symbols GROUP BY 1) y ON y.document_id = d.doc_id""")
def _(t: Tables) -> DataFrame:
    return read.child_counts(t.documents, t.sections, t.chunks, t.symbols)


@_query("s8_with_children", """SELECT d.doc_id, d.path, CAST((SELECT count(*) FROM document_sections s WHERE s.document_id = d.doc_id) AS BIGINT) AS n_sections,
  (SELECT md5(string_agg(content, chr(10) ORDER BY chunk_index, id)) FROM (SELECT DISTINCT id, chunk_index, content FROM document_chunks c WHERE c.document_id = d.doc_id)) AS chunks_md5,
  (SELECT string_agg(name, ',' ORDER BY line_start, name) FROM symbols y WHERE y.document_id = d.doc_id) AS symbols FROM documents d WHERE d.doc_id = (SELECT min(document_id) FROM symbols WHERE document_id IN (SELECT doc_id FROM documents))""")
def _(t: Tables) -> DataFrame:
    one = t.symbols.select("document_id").join(t.documents.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").agg(F.min("document_id")).first()[0]
    row = read.with_children(t.documents, t.sections, t.chunks, t.symbols, F.col("doc_id") == one)
    texts = F.array_join(F.transform("chunks", lambda c: c["content"]), "\n")
    return row.select("doc_id", "path", F.size("sections").cast("bigint").alias("n_sections"), F.md5(texts.cast("binary")).alias("chunks_md5"), F.array_join(F.transform("symbols", lambda y: y["name"]), ",").alias("symbols"))


@_query("j6_deleted", "SELECT path FROM documents WHERE path NOT IN (SELECT path FROM documents WHERE text IS NOT NULL AND text <> '')")
def _(t: Tables) -> DataFrame:
    from folioscope.operators import index

    scanned = t.documents.where("text is not null and text <> ''").select("path", F.col("hash"))
    return index.classify(scanned, t.documents.select("path", "hash")).where("status = 'deleted'").select("path")


@_query("j7_changed", """SELECT s.path, CASE WHEN d.hash IS NULL THEN 'new' WHEN d.hash <> s.hash THEN 'changed' ELSE 'unchanged' END AS status
  FROM (SELECT path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) s LEFT JOIN (SELECT path, hash FROM documents WHERE document_type <> 'pdf') d USING (path)""")
def _(t: Tables) -> DataFrame:
    from folioscope.operators import index

    scanned = t.documents.where("text is not null").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return index.classify(scanned, t.documents.where("document_type <> 'pdf'").select("path", "hash")).where("status <> 'deleted'").select("path", "status")


@_query("j11_polymorphic_source", """SELECT e.id, coalesce(dc.path, dd.path) AS source_path FROM relationships e
  LEFT JOIN (SELECT DISTINCT id, document_id FROM document_chunks) c ON e.source_type = 'Chunk' AND c.id = e.source_id LEFT JOIN documents dc ON dc.doc_id = c.document_id
  LEFT JOIN documents dd ON e.source_type = 'Document' AND dd.doc_id = e.source_id
  JOIN symbols s ON s.id = e.target_id WHERE e.target_type = 'Symbol' AND e.relationship_type IN ('REFERENCES', 'MENTIONS', 'CALLS') AND s.name ILIKE '%%'""")
def _(t: Tables) -> DataFrame:
    return graph.references(t.edges, t.symbols, t.chunks, t.documents, "").select(F.col("edge_id").alias("id"), "source_path")


# --- aggregates --------------------------------------------------------------------------------


@_query("a1_table_counts", """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'sections', count(*) FROM document_sections
  UNION ALL SELECT 'chunks', count(DISTINCT id) FROM document_chunks UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'relationships', count(*) FROM relationships""")
def _(t: Tables) -> DataFrame:
    stats = read.statistics(t.documents, t.sections, t.chunks, t.symbols, t.edges)
    return stats.where(F.col("metric").isin("documents", "sections", "chunks", "symbols", "relationships")).select(F.col("metric").alias("name"), F.col("value").alias("n"))


@_query("a2_embedded_count", "SELECT count(DISTINCT id) FILTER (WHERE embedding IS NOT NULL) AS embedded, count(DISTINCT id) AS chunks FROM document_chunks")
def _(t: Tables) -> DataFrame:
    return read.embedded_counts(t.chunks)


@_query("a3_last_indexed", "SELECT max(indexed_at) AS last_indexed, max(modified_at) AS last_modified FROM documents")
def _(t: Tables) -> DataFrame:
    return read.last_times(t.documents)


@_query("a4_by_type", "SELECT document_type, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return read.breakdown(t.documents, "document_type")


@_query("a5_by_ext", "SELECT extension, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return read.breakdown(t.documents, "extension")


@_query("a8_ordered_concat", f"""SELECT document_id, md5(string_agg(content, chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, id)) AS content_md5 FROM {S.CHUNKS} GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = filters.distinct_chunks(t.chunks.select("id", "document_id", "chunk_index", "content", "token_count"))
    return read.concatenated(rows).select("document_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@_query("a9_token_sum", f"""SELECT document_id, CAST(CASE WHEN coalesce(sum(token_count), 0) > 0 THEN sum(token_count)
  ELSE ceil(length(string_agg(content, chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, id)) / 4.0) END AS BIGINT) AS tokens FROM {S.CHUNKS} GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = filters.distinct_chunks(t.chunks.select("id", "document_id", "token_count", "content"))
    return read.token_sums(rows).select("document_id", F.col("token_count").alias("tokens"))


@_query("a11_latency", "SELECT event_type AS tool, round_even(avg(value), 2) AS avg_value, count(*) AS n, count(*) FILTER (WHERE value < 1) AS failures FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from folioscope.metrics import summarise

    return summarise(t.events.select(F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), (F.col("value") >= 1).alias("ok"))).select("tool", F.col("avg_ms").alias("avg_value"), "n", "failures")


@_query("a13_prefix_dedupe", f"SELECT id AS chunk_id FROM (SELECT id, row_number() OVER (PARTITION BY substr(content, 1, 80) ORDER BY id) AS n FROM {S.CHUNKS}) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    return context.first_of_beginnings(t.chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").select("chunk_id")


_TOP20 = "SELECT chunk_id, document_id, path, filename, row_number() OVER (ORDER BY round(fts_rank, 9) DESC, chunk_id) AS rank, fts_rank AS score FROM (" + S.top(S.fts_two("schema", "index"), "fts_rank", 20) + ")"


def _candidates(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    top = search.text_top(t.chunks, t.documents, search.SearchQuery("schema index", 20), "simple")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("fts_rank", 9)), "chunk_id")))
    return ranked.select("chunk_id", "rank", "filename", "path", F.lit(None).cast("string").alias("section_title"), F.lit("x").alias("location"), F.col("fts_rank").alias("score"))


_PACK = rf"""
WITH top AS ({_TOP20}),
c AS (SELECT t.*, k.content, row_number() OVER (PARTITION BY substr(k.content, 1, 80) ORDER BY rank) AS n FROM top t JOIN {S.CHUNKS} k ON k.id = t.chunk_id),
e AS (SELECT chunk_id, rank, filename, chr(10) || '### [' || filename || '] Excerpt' || chr(10) || 'Location: x | Path: ' || path || ' | Score: ' || printf('%.3f', score) || chr(10) || '```' || chr(10) AS header,
  {S.TRIM.format("coalesce(content, '')")} AS body FROM c WHERE n = 1),
s AS (SELECT *, sum(length(header) + length(body) + 5) OVER (ORDER BY rank) AS fin, length(header) + length(body) + 5 AS len FROM e),
o AS (SELECT *, fin > 6000 AS over_, sum(CASE WHEN fin > 6000 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS nth, 6000 - (fin - len) - length(header) - 105 AS room FROM s)
SELECT chunk_id, CAST(rank AS INTEGER) AS rank, (over_ AND nth = 1 AND room > 200) AS truncated, CAST(least(fin, 6000) AS BIGINT) AS end_offset FROM o WHERE NOT over_ OR (nth = 1 AND room > 200)"""


_CONTEXT = rf"""
WITH r AS ({S.top(S.fts_two("schema", "index", S.STEMMED), "fts_rank", 20)}),
top AS (SELECT *, row_number() OVER (ORDER BY round(fts_rank, 9) DESC, chunk_id) AS rank, fts_rank AS score FROM r),
c AS (SELECT t.chunk_id, t.rank, t.filename, t.path, t.score, k.content, coalesce(k.section_title, 'Excerpt') AS title, coalesce({S.LOCATION}, '') AS location, row_number() OVER (PARTITION BY substr(k.content, 1, 80) ORDER BY rank) AS n FROM top t JOIN {S.CHUNKS} k ON k.id = t.chunk_id),
e AS (SELECT *, chr(10) || '### [' || filename || '] ' || title || chr(10) || 'Location: ' || location || ' | Path: ' || path || ' | Score: ' || printf('%.3f', score) || chr(10) || '```' || chr(10) AS header,
  {S.TRIM.format("coalesce(content, '')")} AS body FROM c WHERE n = 1),
s AS (SELECT *, 120 + sum(length(header) + length(body) + 5) OVER (ORDER BY rank) AS fin, length(header) + length(body) + 5 AS len FROM e),
o AS (SELECT *, fin > 8000 AS over_, sum(CASE WHEN fin > 8000 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS nth, CAST(8000 - (fin - len) - length(header) - 105 AS BIGINT) AS room FROM s),
k AS (SELECT *, (over_ AND nth = 1 AND room > 200) AS truncated FROM o WHERE NOT over_ OR (nth = 1 AND room > 200))
SELECT chunk_id, CAST(rank AS INTEGER) AS rank, truncated, CAST(least(fin, 8000) AS BIGINT) AS end_offset,
  md5(header || CASE WHEN truncated THEN substr(body, 1, room) || chr(10) || '... [truncated to fit token budget]' || chr(10) ELSE body END || chr(10) || '```' || chr(10)) AS excerpt_md5 FROM k"""


@_query("a14_budget_pack", _PACK)
def _(t: Tables) -> DataFrame:
    return context.pack(context.excerpts(_candidates(t), t.chunks), 6000).select("chunk_id", "rank", "truncated", "end_offset")


# --- order -------------------------------------------------------------------------------------


@_query("o4_list_page", "SELECT doc_id, filename FROM documents ORDER BY filename, doc_id LIMIT 50 OFFSET 100")
def _(t: Tables) -> DataFrame:
    return read.list_documents(t.documents, limit=50, offset=100).select("doc_id", "filename")


@_query("o5_find_rank", "SELECT id, name FROM symbols WHERE name ILIKE '%query%' ORDER BY length(name), name, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return read.find_symbols(t.symbols, t.documents, "query").select("id", "name")


@_query("o6_chunk_order", f"SELECT id AS chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS INTEGER) AS place FROM {S.CHUNKS}")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_places(filters.distinct_chunks(t.chunks.select("id", "document_id", "chunk_index"))).select(F.col("id").alias("chunk_id"), "place")


@_query("o9_top3_per_doc", "SELECT source_id, id FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM relationships WHERE source_type = 'Document') WHERE n <= 3")
def _(t: Tables) -> DataFrame:
    return context.first_edges(t.edges, "source").select("source_id", "id")


_LINES = "SELECT doc_id, filename, doc_id AS rank FROM documents WHERE document_type = 'pdf'"


@_query("o9_relationship_lines", f"""WITH d AS ({_LINES}),
o AS (SELECT rank, filename, 'outgoing' AS direction, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n, relationship_type AS t, target_type || ' #' || target_id AS x FROM relationships r JOIN d ON r.source_id = d.doc_id WHERE source_type = 'Document'),
i AS (SELECT rank, filename, 'incoming' AS direction, row_number() OVER (PARTITION BY target_id ORDER BY id) AS n, relationship_type AS t, source_type || ' #' || source_id AS x FROM relationships r JOIN d ON r.target_id = d.doc_id
  WHERE target_type = 'Document' AND NOT (source_type = 'Document' AND source_id = target_id))
SELECT rank, direction, CAST(n AS INTEGER) AS position, CASE WHEN direction = 'outgoing' THEN '• [' || filename || '] --(' || t || ')--> [' || x || ']' ELSE '• [' || x || '] --(' || t || ')--> [' || filename || ']' END AS line
  FROM (SELECT * FROM o UNION ALL SELECT * FROM i) WHERE n <= 3""")
def _(t: Tables) -> DataFrame:
    docs = t.documents.where("document_type = 'pdf'").select("doc_id", "filename", F.col("doc_id").alias("rank"))
    return context.relationship_lines(t.edges, t.documents, docs)


@_query("o12_breakdown", "SELECT document_type, n FROM (SELECT document_type, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, document_type")
def _(t: Tables) -> DataFrame:
    return read.breakdown(t.documents, "document_type")


# --- retrieval ---------------------------------------------------------------------------------

_VECTOR = "(SELECT embedding FROM document_chunks WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda z: abs(z::DOUBLE))) BETWEEN 1e-9 AND 1e9 ORDER BY id LIMIT 1)"
_SIMILAR = f"""SELECT id AS chunk_id, document_id, {S.cosine('embedding', 'q.v')} AS similarity FROM {S.CHUNKS} c, (SELECT {_VECTOR} AS v) q
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda z: abs(z::DOUBLE))) > 0 AND isfinite(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))"""


def _vector(t: Tables) -> list[float]:
    """The first usable embedding serves as the query's vector."""
    v = F.transform("embedding", lambda z: F.abs(z.cast("double")))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    row = t.chunks.where((F.size("embedding") == 64) & total.between(1e-9, 1e9)).select("id", "embedding").orderBy("id").limit(1).first()
    return [float(x) for x in row["embedding"]]


@_query("x1_cosine", f"SELECT chunk_id, round(similarity, 6) AS similarity FROM ({_SIMILAR})")
def _(t: Tables) -> DataFrame:
    v = F.array(*(F.lit(x) for x in _vector(t)))
    s = t.chunks.select(F.col("id").alias("chunk_id"), X.cosine(F.col("embedding"), v).alias("s")).where("s is not null and not isnan(s)")
    return s.select("chunk_id", F.round("s", 6).alias("similarity")).dropDuplicates(["chunk_id"])


@_query("r1_fts_single", "SELECT chunk_id, document_id, round(fts_rank, 6) AS fts_rank FROM (" + S.top(S.fts_one("index", S.STEMMED), "fts_rank", 10) + ")")
def _(t: Tables) -> DataFrame:
    return search.text_top(t.chunks, t.documents, search.SearchQuery("the indexes")).select("chunk_id", "document_id", F.round("fts_rank", 6).alias("fts_rank"))


@_query("r1_fts_and2", "SELECT chunk_id, document_id, round(fts_rank, 6) AS fts_rank FROM (" + S.top(S.fts_two("schema", "index", S.STEMMED), "fts_rank", 10) + ")")
def _(t: Tables) -> DataFrame:
    return search.text_top(t.chunks, t.documents, search.SearchQuery("schemas indexing")).select("chunk_id", "document_id", F.round("fts_rank", 6).alias("fts_rank"))


@_query("r1_fts_filtered", "SELECT chunk_id, path, round(fts_rank, 6) AS fts_rank FROM (" + S.top(S.fts_one("schema", S.STEMMED), "fts_rank", 10, "d.document_type = 'document' AND d.extension = '.md' AND starts_with(d.path, '/data/')") + ")")
def _(t: Tables) -> DataFrame:
    q = search.SearchQuery("schema", document_type="document", extension="md", path_prefix="/data/")
    return search.text_top(t.chunks, t.documents, q).select("chunk_id", "path", F.round("fts_rank", 6).alias("fts_rank"))


@_query("r1_fts_simple", "SELECT chunk_id, document_id, round(fts_rank, 6) AS fts_rank FROM (" + S.top(S.fts_two("the", "index"), "fts_rank", 10) + ")")
def _(t: Tables) -> DataFrame:
    return search.text_top(t.chunks, t.documents, search.SearchQuery("the index"), "simple").select("chunk_id", "document_id", F.round("fts_rank", 6).alias("fts_rank"))


@_query("r1_fts_indexed", "SELECT chunk_id, document_id, round(fts_rank, 6) AS fts_rank FROM (" + S.top(S.fts_two("schema", "index", S.STEMMED), "fts_rank", 10) + ")")
def _(t: Tables) -> DataFrame:
    """The same search over postings, as an index stores them."""
    versions = t.documents.select(F.col("doc_id").alias("document_id"), search.version_of(F.col("hash")).alias("version"))
    rows = search.build_postings(t.chunks).join(versions, "document_id").withColumn("bucket", search.term_bucket(F.col("term")))
    return search.text_top(t.chunks, t.documents, search.SearchQuery("schemas indexing"), postings=rows).select("chunk_id", "document_id", F.round("fts_rank", 6).alias("fts_rank"))


@_query("r1_postings", rf"""SELECT term, id AS chunk_id, len(list_filter(w, lambda x: x = term)) AS n FROM (SELECT id, w, unnest(list_distinct(w)) AS term FROM (SELECT id, {S.TOKENS} AS w FROM {S.CHUNKS} WHERE content IS NOT NULL))""")
def _(t: Tables) -> DataFrame:
    return search.build_postings(t.chunks, "simple").select("term", "chunk_id", F.size("positions").cast("bigint").alias("n"))


_ENGLISH = f"""SELECT id AS chunk_id, document_id, 0.1 * (n_phrase + CASE WHEN list_contains(w, 'warehous') THEN 0 ELSE n_replica END) AS fts_rank
  FROM (SELECT id, document_id, w, len(list_filter(w, lambda x: x = 'replica')) AS n_replica, len(list_filter(range(1, len(w)), lambda i: w[i] = 'schema' AND w[i + 1] = 'index')) AS n_phrase
    FROM (SELECT id, document_id, {S.STEMMED} AS w FROM {S.CHUNKS} WHERE content IS NOT NULL)) WHERE n_phrase > 0 OR (n_replica > 0 AND NOT list_contains(w, 'warehous'))"""


@_query("r1_fts_english", "SELECT r.chunk_id, r.document_id, r.path, c.section_title, c.location, round(r.fts_rank, 6) AS score FROM (" + S.top(_ENGLISH, "fts_rank", 10) + f") r JOIN (SELECT id, section_title, {S.LOCATION} AS location FROM {S.CHUNKS}) c ON c.id = r.chunk_id")
def _(t: Tables) -> DataFrame:
    found = search.text_search(t.chunks, t.documents, search.SearchQuery('"schema index" or replicas -warehouse'))
    return found.select("chunk_id", "document_id", "path", "section_title", "location", F.round("score", 6).alias("score"))


@_query("r2_semantic", "SELECT chunk_id, document_id, round(similarity, 6) AS similarity FROM (" + S.top(_SIMILAR, "similarity", 10) + ")")
def _(t: Tables) -> DataFrame:
    return search.semantic_top(t.chunks, t.documents, search.SearchQuery("x"), _vector(t)).select("chunk_id", "document_id", F.round("similarity", 6).alias("similarity"))


_HYBRID = f"""
WITH f AS (SELECT *, row_number() OVER (ORDER BY round(fts_rank, 9) DESC, chunk_id) AS p FROM ({S.top(S.fts_two('schema', 'index', S.STEMMED), 'fts_rank', 30)})),
s AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9) DESC, chunk_id) AS p FROM ({S.top(_SIMILAR, 'similarity', 30)})),
b AS (SELECT coalesce(f.chunk_id, s.chunk_id) AS chunk_id, f.p AS text_pos, s.p AS semantic_pos, coalesce(40.0 / (60 + f.p), 0) + coalesce(60.0 / (60 + s.p), 0) AS score FROM f FULL JOIN s ON f.chunk_id = s.chunk_id)
SELECT chunk_id, CAST(text_pos AS INTEGER) AS text_pos, CAST(semantic_pos AS INTEGER) AS semantic_pos, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, text_pos NULLS LAST, semantic_pos NULLS LAST, chunk_id LIMIT 10"""


@_query("r4_hybrid_rrf", _HYBRID)
def _(t: Tables) -> DataFrame:
    top = search.hybrid_top(t.chunks, t.documents, search.SearchQuery("schema indexes"), _vector(t))
    return top.select("chunk_id", "text_pos", "semantic_pos", F.round("score", 6).alias("score"))


@_query("r4_hybrid_results", f"""SELECT h.chunk_id, d.path, c.section_title, c.location, h.score FROM ({_HYBRID}) h
  JOIN (SELECT id, document_id, section_title, {S.LOCATION} AS location FROM {S.CHUNKS}) c ON c.id = h.chunk_id JOIN documents d ON d.doc_id = c.document_id""")
def _(t: Tables) -> DataFrame:
    found = search.hybrid_search(t.chunks, t.documents, search.SearchQuery("schema indexes"), _vector(t))
    return found.select("chunk_id", "path", "section_title", "location", F.round("score", 6).alias("score"))


@_query("r5_read_lines", "SELECT DISTINCT c.id AS chunk_id, c.chunk_index FROM document_chunks c JOIN documents d ON d.doc_id = c.document_id WHERE d.doc_id = (SELECT min(doc_id) FROM documents WHERE document_type = 'code') AND c.line_start <= 60 AND c.line_end >= 10")
def _(t: Tables) -> DataFrame:
    path = t.documents.where("document_type = 'code'").orderBy("doc_id").select("path").first()[0]
    return read.read_chunks(t.chunks, t.symbols, t.documents, read.ReadRequest(path, line_start=10)).select(F.col("id").alias("chunk_id"), "chunk_index")


@_query("r5_read_symbol", """
WITH y AS (SELECT document_id, line_start AS a, line_end AS b, name FROM symbols WHERE id = (SELECT min(id) FROM symbols WHERE document_id IN (SELECT doc_id FROM documents)))
SELECT DISTINCT c.id AS chunk_id FROM document_chunks c, y WHERE c.document_id = y.document_id AND ((c.line_start <= y.b AND c.line_end >= y.a) OR contains(lower(c.section_title), lower(y.name)))""")
def _(t: Tables) -> DataFrame:
    row = t.symbols.join(t.documents.select(F.col("doc_id").alias("document_id"), "path"), "document_id").orderBy("id").select("path", "name").first()
    return read.read_chunks(t.chunks, t.symbols, t.documents, read.ReadRequest(row["path"], symbol=row["name"])).select(F.col("id").alias("chunk_id"))


def _read(name: str, given: str, where: str, more: str = "") -> None:
    """One selector of R5, on the smallest document that has chunks for it."""
    doc = f"(SELECT min(c.document_id) FROM document_chunks c JOIN documents d ON d.doc_id = c.document_id WHERE {where})"

    @_query(name, f"SELECT DISTINCT id AS chunk_id, chunk_index FROM document_chunks WHERE document_id = {doc}{' AND ' + where if given else ''}")
    def _(t: Tables) -> DataFrame:
        held = t.chunks.where(where).join(t.documents.select(F.col("doc_id").alias("document_id"), "path"), "document_id").select("document_id", "path")
        path = held.orderBy("document_id").limit(1).first()["path"]
        value = {"page": 2, "slide": 1, "sheet": "SHEET1"}.get(given)
        return read.read_chunks(t.chunks, t.symbols, t.documents, read.ReadRequest(path, **({given: value} if given else {}))).select(F.col("id").alias("chunk_id"), "chunk_index")


_read("r5_read_page", "page", "page_number = 2")
_read("r5_read_slide", "slide", "slide_number = 1")
_read("r5_read_sheet", "sheet", "lower(sheet_name) = 'sheet1'")
_read("r5_read_whole", "", "chunk_index > 2")


@_query("r5_read_section", """WITH s AS (SELECT document_id, section_title FROM document_chunks c JOIN documents d ON d.doc_id = c.document_id WHERE length(section_title) > 3 ORDER BY document_id, section_title LIMIT 1)
  SELECT DISTINCT c.id AS chunk_id, c.chunk_index FROM document_chunks c JOIN s USING (document_id) WHERE contains(lower(c.section_title), lower(s.section_title))""")
def _(t: Tables) -> DataFrame:
    held = t.chunks.where(F.length("section_title") > 3).join(t.documents.select(F.col("doc_id").alias("document_id"), "path"), "document_id")
    row = held.select("document_id", "section_title", "path").orderBy("document_id", "section_title").limit(1).first()
    return read.read_chunks(t.chunks, t.symbols, t.documents, read.ReadRequest(row["path"], section=row["section_title"].upper())).select(F.col("id").alias("chunk_id"), "chunk_index")


@_query("r6_context_rows", _CONTEXT)
def _(t: Tables) -> DataFrame:
    """What a context request packs: results of a search with their titles and places."""
    found = search.text_search(t.chunks, t.documents, search.SearchQuery("schemas indexing", context.CANDIDATES))
    return context.pack(context.excerpts(context.ranked(found), t.chunks), 8000, 120).select("chunk_id", "rank", "truncated", "end_offset", F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"))


@_query("r7_resolve_path", "SELECT doc_id, 1 AS stage FROM documents WHERE path = (SELECT max(path) FROM documents)")
def _(t: Tables) -> DataFrame:
    return read.resolve_document(t.documents, t.documents.agg(F.max("path")).first()[0])


@_query("r7_resolve_filename", "SELECT min(doc_id) AS doc_id, 2 AS stage FROM documents WHERE filename = (SELECT max(filename) FROM documents)")
def _(t: Tables) -> DataFrame:
    return read.resolve_document(t.documents, "elsewhere/" + t.documents.agg(F.max("filename")).first()[0])


@_query("r7_resolve_doc", "SELECT doc_id, 3 AS stage FROM documents WHERE path ILIKE '%schema%' ORDER BY doc_id LIMIT 1")
def _(t: Tables) -> DataFrame:
    return read.resolve_document(t.documents, "SCHEMA")


@_query("r8_outline", """
WITH d AS (SELECT doc_id, coalesce(title, filename) AS title FROM documents WHERE path ILIKE '%index%' ORDER BY doc_id LIMIT 1)
SELECT d.doc_id, d.title, 'section' AS part, s.section_index AS position, s.title AS label, s.depth AS depth, NULL::INTEGER AS line_start, NULL::INTEGER AS line_end FROM document_sections s JOIN d ON d.doc_id = s.document_id
UNION ALL SELECT d.doc_id, d.title, 'symbol', y.line_start, concat_ws(' ', y.symbol_type, y.name), 0, y.line_start, y.line_end FROM symbols y JOIN d ON d.doc_id = y.document_id""")
def _(t: Tables) -> DataFrame:
    return read.outline(t.documents, t.sections, t.symbols, "index")


@_query("r9_find_symbols", "SELECT s.id, s.name, s.symbol_type, d.path FROM (SELECT * FROM symbols WHERE name ILIKE '%load%' AND symbol_type = 'Method' ORDER BY length(name), name, id LIMIT 20) s LEFT JOIN documents d ON d.doc_id = s.document_id")
def _(t: Tables) -> DataFrame:
    return read.find_symbols(t.symbols, t.documents, "load", "Method").select("id", "name", "symbol_type", "path")


@_query("r10_list", "SELECT doc_id, path, filename, extension, title, document_type, size, indexed_at FROM documents WHERE document_type = 'code' AND extension = '.cs' ORDER BY filename, doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return read.list_documents(t.documents, "code", ".cs")


@_query("r11_stats", """SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'last_indexed', CAST(floor(epoch(max(indexed_at))) AS BIGINT) FROM documents
  UNION ALL SELECT 'sections', count(*) FROM document_sections UNION ALL SELECT 'chunks', count(DISTINCT id) FROM document_chunks
  UNION ALL SELECT 'embedded_chunks', count(DISTINCT id) FILTER (WHERE embedding IS NOT NULL) FROM document_chunks UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'relationships', count(*) FROM relationships
  UNION ALL SELECT 'type:' || coalesce(document_type, ''), count(*) FROM documents GROUP BY document_type UNION ALL SELECT 'extension:' || coalesce(extension, ''), count(*) FROM documents GROUP BY extension""")
def _(t: Tables) -> DataFrame:
    return read.statistics(t.documents, t.sections, t.chunks, t.symbols, t.edges)


@_query("r12_open_by_id", "SELECT 'chunk' AS kind, c.id, d.path, CASE WHEN length(c.content) > 12000 THEN NULL ELSE coalesce(c.content, '') END AS content FROM (SELECT DISTINCT id, document_id, content FROM document_chunks WHERE id = 11) c LEFT JOIN documents d ON d.doc_id = c.document_id")
def _(t: Tables) -> DataFrame:
    return read.open_by_id(t.chunks, t.documents, 11)


@_query("r12_open_document", f"""WITH d AS (SELECT max(document_id) AS i FROM document_chunks WHERE document_id IN (SELECT doc_id FROM documents) AND document_id NOT IN (SELECT id FROM document_chunks)),
  t AS (SELECT document_id, string_agg(content, chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, id) AS t FROM {S.CHUNKS} GROUP BY 1)
  SELECT 'document' AS kind, d.i AS id, path, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || $${X.CUT_NOTICE}$$ ELSE coalesce(t, '') END AS content FROM d JOIN documents ON doc_id = d.i LEFT JOIN t ON t.document_id = d.i""")
def _(t: Tables) -> DataFrame:
    """The document with that id where no chunk has it."""
    ids = t.chunks.select(F.col("document_id").alias("i")).distinct().join(t.documents.select(F.col("doc_id").alias("i")), "i", "left_semi")
    return read.open_by_id(t.chunks, t.documents, ids.join(t.chunks.select(F.col("id").alias("i")), "i", "left_anti").agg(F.max("i")).first()[0], 500)


# --- graph -------------------------------------------------------------------------------------


@_query("g1_g2_g4_structural", """SELECT document_id AS source_id, 'Document' AS source_type, id AS target_id, 'Section' AS target_type, 'CONTAINS' AS relationship_type FROM document_sections
  UNION ALL SELECT document_id, 'Document', id, 'Chunk', 'CONTAINS' FROM (SELECT DISTINCT id, document_id FROM document_chunks) UNION ALL SELECT document_id, 'Document', id, 'Symbol', 'DEFINED_IN' FROM symbols""")
def _(t: Tables) -> DataFrame:
    return graph.structural_edges(t.sections, t.chunks, t.symbols).select("source_id", "source_type", "target_id", "target_type", "relationship_type")


_MENTIONS = f"""SELECT c.id AS source_id, s.id AS target_id, CASE WHEN d.document_type = 'code' THEN 'REFERENCES' ELSE 'MENTIONS' END AS relationship_type
  FROM (SELECT DISTINCT ON (id) id, document_id, content FROM document_chunks) c JOIN documents d ON d.doc_id = c.document_id JOIN symbols s ON s.document_id <> c.document_id AND length(s.name) >= 4 AND contains(c.content, s.name)"""


@_query("g6_mentions", _MENTIONS)
def _(t: Tables) -> DataFrame:
    return graph.mentions(t.chunks, t.symbols, t.documents).select("source_id", "target_id", "relationship_type")


@_query("g7_clear_source", "SELECT id FROM relationships WHERE NOT (source_id = 3 AND source_type = 'Document')")
def _(t: Tables) -> DataFrame:
    return graph.clear_source(t.edges, 3, "Document").select("id")


@_query("g8_build_counts", f"""SELECT relationship_type, source_type, target_type, count(*) AS n FROM (
  SELECT 'CONTAINS' AS relationship_type, 'Document' AS source_type, 'Section' AS target_type FROM document_sections
  UNION ALL SELECT 'CONTAINS', 'Document', 'Chunk' FROM (SELECT DISTINCT id FROM document_chunks) UNION ALL SELECT 'DEFINED_IN', 'Document', 'Symbol' FROM symbols
  UNION ALL SELECT relationship_type, 'Chunk', 'Symbol' FROM ({_MENTIONS})) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return graph.build_all(t.documents, t.sections, t.chunks, t.symbols).groupBy("relationship_type", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


@_query("g10_related", """
WITH n AS (SELECT min(id) AS id FROM symbols WHERE name ILIKE '%session%')
SELECT 'outgoing' AS direction, relationship_type, target_id AS neighbour_id, target_type AS neighbour_type, target_type || ' #' || target_id AS neighbour, round_even(confidence::DOUBLE, 2) AS confidence FROM relationships, n WHERE source_type = 'Symbol' AND source_id = n.id
UNION ALL SELECT 'incoming', relationship_type, source_id, source_type, source_type || ' #' || source_id, round_even(confidence::DOUBLE, 2) FROM relationships, n
  WHERE target_type = 'Symbol' AND target_id = n.id AND NOT (source_type = 'Symbol' AND source_id = n.id)""")
def _(t: Tables) -> DataFrame:
    return graph.related(t.edges, t.symbols, t.documents, "session")


@_query("g11_references", """SELECT e.id AS edge_id, e.relationship_type, e.target_id, s.name AS target, s.symbol_type AS target_kind, e.source_id, e.source_type, coalesce(dc.path, dd.path) AS source_path, round_even(e.confidence::DOUBLE, 2) AS confidence
  FROM relationships e JOIN symbols s ON s.id = e.target_id AND s.name ILIKE '%index%'
  LEFT JOIN (SELECT DISTINCT id, document_id FROM document_chunks) c ON e.source_type = 'Chunk' AND c.id = e.source_id LEFT JOIN documents dc ON dc.doc_id = c.document_id
  LEFT JOIN documents dd ON e.source_type = 'Document' AND dd.doc_id = e.source_id
  WHERE e.target_type = 'Symbol' AND e.relationship_type IN ('REFERENCES', 'MENTIONS', 'CALLS')""")
def _(t: Tables) -> DataFrame:
    return graph.references(t.edges, t.symbols, t.chunks, t.documents, "index")


# --- change stream -----------------------------------------------------------------------------


@_query("t3_coalesce", "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, (ts, event_id)) AS op, max(ts) AS ts FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from folioscope.streaming.changes import coalesce

    return coalesce(t.events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").alias("seq"))).select("path", "op", "ts")


@_query("t4_debounce_sessions", """SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (
  SELECT path, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS g
  FROM (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY path, g""")
def _(t: Tables) -> DataFrame:
    from folioscope.streaming.changes import debounce_sessions

    return debounce_sessions(t.events.select(F.col("user_id").cast("string").alias("path"), "ts"), "6 hours")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
