"""The edge table: building, neighbourhoods, references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.cluster import checked_broadcast, materialise, spread
from folioscope.functions import text as X
from folioscope.operators.filters import distinct_chunks, incident, references_to_symbols

EDGE_COLUMNS = ["source_id", "source_type", "target_id", "target_type", "relationship_type", "confidence", "metadata"]
MIN_NAME = 4
MENTION_CONFIDENCE = 0.85
#: Names that one compiled matcher holds; more names are matched in several passes.
NAMES_PER_MATCHER = 200_000


def _edge(source: str, source_type: str, target: str, target_type: str, kind: str) -> list:
    none = F.lit(None).cast("map<string,string>")
    return [
        F.col(source).cast("bigint").alias("source_id"), F.lit(source_type).alias("source_type"), F.col(target).cast("bigint").alias("target_id"), F.lit(target_type).alias("target_type"),
        F.lit(kind).alias("relationship_type"), F.lit(1.0).cast("float").alias("confidence"), none.alias("metadata"),
    ]


def structural_edges(sections: DataFrame, chunks: DataFrame, symbols: DataFrame, parents: bool = False) -> DataFrame:
    """Containment and definition edges, confidence 1.

    ``parents`` adds Section to Chunk and Symbol to Symbol edges where those links are stored.
    """
    ids = distinct_chunks(chunks.select("id", "document_id", "section_id"))
    out = sections.select(*_edge("document_id", "Document", "id", "Section", "CONTAINS"))
    out = out.unionByName(ids.select(*_edge("document_id", "Document", "id", "Chunk", "CONTAINS")))
    out = out.unionByName(symbols.select(*_edge("document_id", "Document", "id", "Symbol", "DEFINED_IN")))
    if parents:
        out = out.unionByName(ids.where("section_id is not null").select(*_edge("section_id", "Section", "id", "Chunk", "CONTAINS")))
        out = out.unionByName(symbols.where("parent_symbol_id is not null").select(*_edge("parent_symbol_id", "Symbol", "id", "Symbol", "CONTAINS")))
    return out


def _names_in(chunks: DataFrame, names: list[str]) -> DataFrame:
    """``(id, document_id, name)``: which of the names each content contains, case-sensitively."""
    held = chunks.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        matcher = ahocorasick.Automaton()
        for k, name in enumerate(held.value):
            matcher.add_word(name, k)
        matcher.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                hits = {k for _, k in matcher.iter(text)} if held.value else ()
                rows += [row] * len(hits)
                found += [held.value[k] for k in hits]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string())], names=["id", "document_id", "name"])

    return spread(chunks, "id").mapInArrow(run, "id bigint, document_id bigint, name string")


def mentions(chunks: DataFrame, symbols: DataFrame, documents: DataFrame, max_symbols: int | None = None) -> DataFrame:
    """An edge from each chunk to each symbol of another document whose name (of at least
    four characters) its content contains; REFERENCES if the chunk's document is code, else
    MENTIONS; confidence 0.85.

    ``max_symbols`` keeps, for each chunk, only the so many symbols of other documents with the
    smallest ids; None keeps all.  Instead of comparing each chunk with each symbol, the distinct
    names are compiled into a multi-pattern matcher, at most NAMES_PER_MATCHER names at a time (more
    names are matched in several passes over the contents), and the hits are joined with the symbols
    by name.  Contents are read where they lie: only hits are shuffled, and those of chunks delivered
    twice are told by id.
    """
    named = symbols.where(F.length("name") >= MIN_NAME).select(F.col("id").alias("symbol_id"), "name", F.col("document_id").alias("symbol_document"))
    if max_symbols is not None:
        # The n smallest ids outside one's own document lie among the n + own smallest overall;
        # only the few documents that define some of them need the longer list.
        own = named.groupBy("symbol_document").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("m")).first()["m"]
        first = named.orderBy("symbol_id").limit(max_symbols + int(own))
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("symbol_id")))
        named = materialise(ranked, "named")
    rows = chunks.where(~X.is_blank(F.col("content"))).select(F.col("id").cast("bigint"), F.col("document_id").cast("bigint"), "content")
    distinct = materialise(named.select("name").distinct(), "names")
    passes = max(1, -(-distinct.count() // NAMES_PER_MATCHER))
    hits = None
    for k in range(passes):
        part = [r[0] for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k).collect()]  # about NAMES_PER_MATCHER
        found = _names_in(rows, part)
        hits = found if hits is None else hits.unionByName(found)
    pairs = hits.distinct().join(named, "name").where(F.col("document_id") != F.col("symbol_document"))
    if max_symbols is not None:
        # Rank among the symbols of other documents: the overall rank less own symbols before it.
        before = named.select(F.col("symbol_document").alias("document_id"), F.col("rank").alias("r"))
        less = pairs.join(checked_broadcast(before), "document_id", "left").groupBy("id", "document_id", "symbol_id", "name", "rank").agg(F.count_if(F.col("r") < F.col("rank")).alias("own"))
        pairs = less.where(F.col("rank") - F.col("own") <= max_symbols)
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("path").alias("_p"), (F.col("document_type") == "code").alias("_code"))
    kind = F.when(F.col("_code"), "REFERENCES").otherwise("MENTIONS")
    meta = F.create_map(F.lit("sourceDoc"), F.col("_p"), F.lit("symbolName"), F.col("name"))
    return pairs.join(docs, "document_id").select(
        F.col("id").alias("source_id"), F.lit("Chunk").alias("source_type"), F.col("symbol_id").alias("target_id"), F.lit("Symbol").alias("target_type"),
        kind.alias("relationship_type"), F.lit(MENTION_CONFIDENCE).cast("float").alias("confidence"), meta.alias("metadata"),
    )


def build_all(documents: DataFrame, sections: DataFrame, chunks: DataFrame, symbols: DataFrame, parents: bool = False, max_symbols: int | None = None) -> DataFrame:
    """All edges in one set-based job; building again gives the same edges (no duplicates)."""
    return structural_edges(sections, chunks, symbols, parents).unionByName(mentions(chunks, symbols, documents, max_symbols))


def clear_source(edges: DataFrame, source_id: int, source_type: str) -> DataFrame:
    """The edges without those that start at an item."""
    return edges.where(~((F.col("source_id") == source_id) & (F.col("source_type") == source_type)))


def incident_edges(edges: DataFrame, item_id: int, item_type: str) -> DataFrame:
    """G9, with ``direction``; a loop counts as outgoing."""
    out = (F.col("source_id") == item_id) & (F.col("source_type") == item_type)
    return edges.where(incident(item_id, item_type)).withColumn("direction", F.when(out, "outgoing").otherwise("incoming"))


def resolve_node(symbols: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """One row ``(node_id, node_type)``: the symbol with the smallest id whose name contains the
    text in any case, else the document by file name or path."""
    s = symbols.where(X.contains_ci(F.col("name"), name)).select(F.lit(1).alias("o"), F.col("id").alias("node_id"), F.lit("Symbol").alias("node_type")).orderBy("node_id").limit(1)
    d = documents.where(X.contains_ci(F.col("filename"), name) | X.contains_ci(F.col("path"), name)).select(F.lit(2).alias("o"), F.col("doc_id").alias("node_id"), F.lit("Document").alias("node_type")).orderBy("node_id").limit(1)
    return s.unionByName(d).orderBy("o").limit(1).drop("o")


def related(edges: DataFrame, symbols: DataFrame, documents: DataFrame, name: str, provider: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """``(direction, relationship_type, neighbour_id, neighbour_type, neighbour, confidence)``
    of the node's edges.  ``provider`` may add edges of an outside call graph in the same columns
    (G12)."""
    node = F.broadcast(resolve_node(symbols, documents, name))
    e = edges.select("source_id", "source_type", "target_id", "target_type", "relationship_type", "confidence")
    as_source = (F.col("source_id") == F.col("node_id")) & (F.col("source_type") == F.col("node_type"))
    as_target = (F.col("target_id") == F.col("node_id")) & (F.col("target_type") == F.col("node_type"))
    hit = e.join(node, as_source | as_target).withColumn("direction", F.when(as_source, "outgoing").otherwise("incoming"))
    out = F.col("direction") == "outgoing"
    near = hit.select("direction", "relationship_type", F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("neighbour_id"), F.when(out, F.col("target_type")).otherwise(F.col("source_type")).alias("neighbour_type"), "confidence")
    rows = near.select("direction", "relationship_type", "neighbour_id", "neighbour_type", F.concat_ws(" #", "neighbour_type", F.col("neighbour_id").cast("string")).alias("neighbour"), F.bround(F.col("confidence").cast("double"), 2).alias("confidence"))
    return rows.unionByName(provider(name)) if provider else rows


def references(edges: DataFrame, symbols: DataFrame, chunks: DataFrame, documents: DataFrame, name: str, provider: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Edges into the symbols whose name contains the text, with the source resolved by its
    type: ``(edge_id, relationship_type, target_id, target, target_kind, source_id, source_type,
    source_path, confidence)``."""
    wanted = symbols.where(X.contains_ci(F.col("name"), name)).select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("symbol_type").alias("target_kind"))
    hit = edges.where(references_to_symbols()).select(F.col("id").alias("edge_id"), "relationship_type", "target_id", "source_id", "source_type", "confidence").join(wanted, "target_id")
    of_chunk = distinct_chunks(chunks.select("id", "document_id")).select(F.col("id").alias("_c"), F.col("document_id").alias("_cd"))
    with_chunk = hit.join(of_chunk, (F.col("source_type") == "Chunk") & (F.col("source_id") == F.col("_c")), "left")
    doc = F.when(F.col("source_type") == "Chunk", F.col("_cd")).when(F.col("source_type") == "Document", F.col("source_id"))
    placed = with_chunk.withColumn("_d", doc).join(documents.select(F.col("doc_id").alias("_d"), F.col("path").alias("source_path")), "_d", "left")
    rows = placed.select("edge_id", "relationship_type", "target_id", "target", "target_kind", "source_id", "source_type", "source_path", F.bround(F.col("confidence").cast("double"), 2).alias("confidence"))
    return rows.unionByName(provider(name)) if provider else rows
