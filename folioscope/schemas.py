"""Schemas of the index tables and of the parsers' intermediate representation."""

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_MAP = T.MapType(_S, _S)


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec.items()])


DOCUMENTS = _struct(
    {
        "doc_id": _L, "text": _S, "path": _S, "filename": _S, "extension": _S, "mime_type": _S, "title": _S, "document_type": _S, "size": _L, "hash": _S,
        "modified_at": T.TimestampType(), "indexed_at": T.TimestampType(), "parser": _S, "language": _S, "metadata": _MAP,
    }
)
SECTIONS = _struct({"id": _L, "document_id": _L, "parent_id": _L, "section_index": _I, "title": _S, "page_number": _I, "slide_number": _I, "sheet_name": _S, "depth": _I, "metadata": _MAP})
CHUNKS = _struct(
    {
        "id": _L, "document_id": _L, "section_id": _L, "chunk_index": _I, "content": _S, "token_count": _I, "page_number": _I, "slide_number": _I, "sheet_name": _S,
        "line_start": _I, "line_end": _I, "section_title": _S, "embedding": T.ArrayType(T.FloatType()), "metadata": _MAP,
    }
)
SYMBOLS = _struct({"id": _L, "document_id": _L, "name": _S, "symbol_type": _S, "namespace": _S, "parent_symbol_id": _L, "line_start": _I, "line_end": _I, "signature": _S, "metadata": _MAP})
RELATIONSHIPS = _struct({"id": _L, "source_id": _L, "source_type": _S, "target_id": _L, "target_type": _S, "relationship_type": _S, "confidence": T.FloatType(), "metadata": _MAP})

TABLES = {"documents": DOCUMENTS, "document_sections": SECTIONS, "document_chunks": CHUNKS, "symbols": SYMBOLS, "relationships": RELATIONSHIPS}

#: Positions of a term in a chunk of one version of its document, in buckets of terms.
POSTINGS = _struct({"bucket": _I, "term": _S, "chunk_id": _L, "document_id": _L, "version": _L, "positions": T.ArrayType(_I)})

#: One section of a parsed file; ``depth`` from 0.
SECTION = _struct({"title": _S, "content": _S, "depth": _I, "page_number": _I, "slide_number": _I, "sheet_name": _S, "line_start": _I, "line_end": _I, "metadata": _MAP})
#: One symbol in pre-order; ``parent`` is the position of the enclosing symbol or null.
SYMBOL = _struct({"name": _S, "kind": _S, "namespace": _S, "signature": _S, "line_start": _I, "line_end": _I, "parent": _I, "content": _S})
#: A parsed file; ``error`` is set instead of raising.
PARSED = _struct(
    {"path": _S, "document_type": _S, "language": _S, "title": _S, "metadata": _MAP, "sections": T.ArrayType(SECTION), "symbols": T.ArrayType(SYMBOL), "error": _S}
)
#: One chunk before it gets its ids.
CHUNK = _struct(
    {"content": _S, "token_count": _I, "page_number": _I, "slide_number": _I, "sheet_name": _S, "line_start": _I, "line_end": _I, "section_title": _S, "metadata": _MAP}
)
