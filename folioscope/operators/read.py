"""Resolution of documents, structured reads, outlines, catalogue and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.filters import distinct_chunks, embedded, on_page, on_sheet, on_slide, overlaps_lines

SEPARATOR = "\n---\n\n"


def resolve_document(documents: DataFrame, name: str, raw_pattern: bool = False) -> DataFrame:
    """At most one row ``(doc_id, stage)``: exact path, else exact file name, else a path that
    contains the text in any case; of several the smallest id."""
    wanted = (name or "").strip()
    base = wanted.replace("\\", "/").rsplit("/", 1)[-1]
    stage = F.when(F.col("path") == wanted, 1).when(F.col("filename") == base, 2).when(X.contains_ci(F.col("path"), wanted, raw_pattern), 3)
    return documents.select("doc_id", stage.alias("stage")).where("stage is not null").orderBy("stage", "doc_id").limit(1)


@dataclass
class ReadRequest:
    document: str
    page: int | None = None
    slide: int | None = None
    sheet: str | None = None
    section: str | None = None
    symbol: str | None = None
    line_start: int | None = None
    line_end: int | None = None


def _of_document(rows: DataFrame, doc: DataFrame, column: str = "document_id") -> DataFrame:
    return rows.join(F.broadcast(doc.select(F.col("doc_id").alias(column))), column, "left_semi")


def read_chunks(chunks: DataFrame, symbols: DataFrame, documents: DataFrame, request: ReadRequest) -> DataFrame:
    """The chunks of a document that the first given selector picks: symbol, page, slide,
    sheet, section, lines, else all.  Each chunk once."""
    doc = resolve_document(documents, request.document)
    own = distinct_chunks(_of_document(chunks, doc).drop("embedding", "metadata"))
    if request.symbol:
        hit = _of_document(symbols, doc).where(X.contains_ci(F.col("name"), request.symbol)).orderBy("id").limit(1).select(F.col("line_start").alias("_a"), F.col("line_end").alias("_b"), F.col("name").alias("_n"))
        one = doc.select(F.lit(1).alias("_one")).join(F.broadcast(hit), F.lit(True), "left")
        # Both sides of the condition are one row at most.
        inside = (F.col("line_start") <= F.col("_b")) & (F.col("line_end") >= F.col("_a"))
        title = F.coalesce(F.col("_n"), F.lit(request.symbol))
        named = F.lower("section_title").contains(F.lower(title))
        return own.join(F.broadcast(one), inside | named, "left_semi")
    if request.page is not None:
        return own.where(on_page(request.page))
    if request.slide is not None:
        return own.where(on_slide(request.slide))
    if request.sheet:
        return own.where(on_sheet(request.sheet))
    if request.section:
        return own.where(X.contains_ci(F.col("section_title"), request.section))
    if request.line_start is not None:
        return own.where(overlaps_lines(request.line_start, request.line_end if request.line_end is not None else request.line_start + 50))
    return own


def token_sums(chunks: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """``(document_id, token_count)``: the sum of the chunks' tokens or, where it is 0, the estimate
    of their concatenation, from the lengths alone: no contents are gathered."""
    length = F.sum(F.length("content")) + F.lit(len(separator)) * (F.count("content") - 1)
    sums = chunks.groupBy("document_id").agg(F.sum("token_count").cast("bigint").alias("_t"), length.alias("_n"))
    estimate = F.ceil(F.col("_n") / F.lit(float(X.TOKEN))).cast("bigint")
    return sums.select("document_id", F.when(F.coalesce("_t", F.lit(0)) > 0, F.col("_t")).otherwise(estimate).alias("token_count"))


def concatenated(chunks: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """``(document_id, content, token_count)``: contents in chunk order and their
    :func:`token_sums`.  A result row holds a whole document, as the operator's result demands."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("chunk_index"), F.col("id"), F.col("content"))))
    joined = chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), separator).alias("content"), F.sum("token_count").cast("bigint").alias("_t"))
    total = F.when(F.coalesce("_t", F.lit(0)) > 0, F.col("_t")).otherwise(X.token_estimate(F.col("content")).cast("bigint"))
    return joined.select("document_id", "content", total.alias("token_count"))


def read_document(chunks: DataFrame, symbols: DataFrame, documents: DataFrame, request: ReadRequest) -> DataFrame:
    """R5 as one row ``(doc_id, path, title, content, token_count)``; empty content if nothing
    matches, no row if there is no such document."""
    picked = concatenated(read_chunks(chunks, symbols, documents, request))
    doc = documents.join(F.broadcast(resolve_document(documents, request.document)), "doc_id", "left_semi").select("doc_id", "path", F.coalesce("title", "filename").alias("title"))
    return doc.join(picked, doc.doc_id == picked.document_id, "left").select("doc_id", "path", "title", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("token_count", F.lit(0)).alias("token_count"))


def read_lines_from_file(spark, path: str, line_start: int | None = None, line_end: int | None = None) -> DataFrame:
    """Lines of a file on disk, to its end where ``line_end`` isn't given: ``(content)``."""
    lines = F.split("value", "\n")
    first = max(line_start or 1, 1)
    count = F.lit(2**31 - 1) if line_end is None else F.lit(max(line_end - first + 1, 0))
    return spark.read.text(path, wholetext=True).select(F.array_join(F.slice(lines, F.lit(first), count), "\n").alias("content"))


def outline(documents: DataFrame, sections: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Rows ``(doc_id, title, part, position, label, depth, line_start, line_end)``; part is
    'section' (by section_index) or 'symbol' (by first line)."""
    doc = resolve_document(documents, name)
    head = documents.join(F.broadcast(doc), "doc_id", "left_semi").select("doc_id", F.coalesce("title", "filename").alias("title"))
    none = F.lit(None).cast("int")
    of = lambda rows: rows.join(F.broadcast(head), rows.document_id == head.doc_id)
    s = of(sections.select("document_id", F.col("title").alias("label"), F.col("section_index").alias("position"), "depth")).select("doc_id", "title", F.lit("section").alias("part"), "position", "label", "depth", none.alias("line_start"), none.alias("line_end"))
    y = of(symbols.select("document_id", F.concat_ws(" ", "symbol_type", "name").alias("label"), "line_start", "line_end")).select("doc_id", "title", F.lit("symbol").alias("part"), F.col("line_start").alias("position"), "label", F.lit(0).alias("depth"), "line_start", "line_end")
    return s.unionByName(y)


def with_children(documents: DataFrame, sections: DataFrame, chunks: DataFrame, symbols: DataFrame, on: Column) -> DataFrame:
    """Documents that meet ``on`` with their sections, chunks and symbols as arrays; each
    child table is aggregated before the join, so children don't multiply."""
    docs = documents.where(on)
    keys = docs.select(F.col("doc_id").alias("document_id"))

    def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        own = rows.select("document_id", *columns).join(keys, "document_id", "left_semi").dropDuplicates()
        return own.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)).withColumnRenamed("document_id", f"_{name}")

    out = docs
    for rows, name, columns in ((sections, "sections", ("section_index", "title", "depth")), (chunks, "chunks", ("chunk_index", "id", "content", "section_title")), (symbols, "symbols", ("line_start", "name", "symbol_type", "line_end"))):
        part = gathered(rows, name, *columns)
        out = out.join(part, out.doc_id == part[f"_{name}"], "left").drop(f"_{name}")
    return out


def open_by_id(chunks: DataFrame, documents: DataFrame, item_id: int, max_chars: int = 12_000) -> DataFrame:
    """``(kind, id, path, content)`` of the chunk with that id, else of the document."""
    c = distinct_chunks(chunks.where(F.col("id") == item_id).select("id", "document_id", "content"))
    chunk = c.join(documents.select(F.col("doc_id").alias("document_id"), "path"), "document_id", "left").select(F.lit(1).alias("_o"), F.lit("chunk").alias("kind"), "id", "path", X.truncate(F.coalesce("content", F.lit("")), max_chars).alias("content"))
    whole = concatenated(distinct_chunks(chunks.where(F.col("document_id") == item_id).select("id", "document_id", "chunk_index", "content", "token_count")))
    document = documents.where(F.col("doc_id") == item_id).join(whole, F.col("doc_id") == F.col("document_id"), "left").select(F.lit(2).alias("_o"), F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "path", X.truncate(F.coalesce("content", F.lit("")), max_chars).alias("content"))
    return chunk.unionByName(document).orderBy("_o").limit(1).drop("_o")


def find_symbols(symbols: DataFrame, documents: DataFrame, name: str, symbol_type: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name contains the text in any case, the shortest names first."""
    hits = symbols.where(X.contains_ci(F.col("name"), name))
    if symbol_type:
        hits = hits.where(F.col("symbol_type") == symbol_type)
    top = hits.orderBy(F.length("name"), "name", "id").limit(limit)
    return with_paths(top.select("id", "document_id", "name", "symbol_type", "namespace", "line_start", "line_end", "signature"), documents)


def with_paths(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """Symbols with the path and file name of their document, null where it is missing."""
    return symbols.join(documents.select(F.col("doc_id").alias("document_id"), "path", "filename"), "document_id", "left")


def child_counts(documents: DataFrame, sections: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """J3 over all documents: ``(doc_id, n_sections, n_chunks, n_symbols)``.  Each child table is
    counted before the join, partly before the shuffle, so no document's children are gathered."""
    out = documents.select("doc_id")
    for rows, name, key in ((sections, "n_sections", "id"), (chunks, "n_chunks", "id"), (symbols, "n_symbols", "id")):
        n = rows.select("document_id", key).distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, out.doc_id == n.document_id, "left").drop("document_id").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out


def list_documents(documents: DataFrame, document_type: str | None = None, extension: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """By file name; the extension is compared as it is given."""
    rows = documents
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    if extension:
        rows = rows.where(F.col("extension") == extension)
    return rows.select("doc_id", "path", "filename", "extension", "title", "document_type", "size", "indexed_at").orderBy("filename", "doc_id").offset(offset).limit(limit)


def embedded_counts(chunks: DataFrame) -> DataFrame:
    """A2: one row ``(embedded, chunks)``; chunks may be delivered twice, so they are reduced to id
    and a flag before they are counted."""
    held = chunks.select("id", embedded().alias("e")).groupBy("id").agg(F.max("e").alias("e"))
    return held.agg(F.count_if("e").alias("embedded"), F.count(F.lit(1)).alias("chunks"))


def last_times(documents: DataFrame) -> DataFrame:
    """A3: one row ``(last_indexed, last_modified)``."""
    return documents.agg(F.max("indexed_at").alias("last_indexed"), F.max("modified_at").alias("last_modified"))


def breakdown(documents: DataFrame, column: str) -> DataFrame:
    """``(column, n)``, the commonest value first."""
    return documents.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def statistics(documents: DataFrame, sections: DataFrame, chunks: DataFrame, symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    """R11 as rows ``(metric, value)``: counts of the tables, of embedded chunks, the last index
    time (seconds), and documents by type and by extension."""
    one = lambda name, c: F.struct(F.lit(name).alias("metric"), c.cast("bigint").alias("value"))
    rows = lambda df, *pairs: df.select(F.inline(F.array(*(one(n, c) for n, c in pairs))))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    out = rows(count(documents), ("documents", F.col("n"))).unionByName(rows(last_times(documents), ("last_indexed", F.unix_timestamp("last_indexed"))))
    out = out.unionByName(rows(count(sections), ("sections", F.col("n")))).unionByName(rows(embedded_counts(chunks), ("chunks", F.col("chunks")), ("embedded_chunks", F.col("embedded"))))
    out = out.unionByName(rows(count(symbols), ("symbols", F.col("n")))).unionByName(rows(count(relationships), ("relationships", F.col("n"))))
    for column, name in (("document_type", "type"), ("extension", "extension")):
        out = out.unionByName(breakdown(documents, column).select(F.concat(F.lit(f"{name}:"), F.coalesce(column, F.lit(""))).alias("metric"), F.col("n").cast("bigint").alias("value")))
    return out
