"""Predicates on documents, chunks, symbols and edges."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import SecurityConfig
from folioscope.functions import text as X

REFERENCE_TYPES = ("REFERENCES", "MENTIONS", "CALLS")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk once (a chunk may be delivered twice in full).  Filter and project first: what
    is left is shuffled by id."""
    return chunks.dropDuplicates(["id"])


def document_filter(document_type: str | None = None, extension: str | None = None, path_prefix: str | None = None, raw_pattern: bool = False) -> Column:
    """Conjunction of the given conditions; a condition that is null or empty is left out."""
    on = F.lit(True)
    if document_type:
        on &= F.col("document_type") == document_type
    if extension:
        on &= F.col("extension") == X.dotted(extension)
    if path_prefix:
        on &= F.col("path").like(path_prefix + "%") if raw_pattern else F.col("path").startswith(path_prefix)
    return on


def overlaps_lines(first: int, last: int) -> Column:
    """Chunks and symbols that share a line with [first, last]; unknown lines never match."""
    return (F.col("line_start") <= last) & (F.col("line_end") >= first)


def embedded() -> Column:
    """chunks with an embedding."""
    return F.col("embedding").isNotNull()


def on_page(page: int) -> Column:
    return F.col("page_number") == page


def on_slide(slide: int) -> Column:
    return F.col("slide_number") == slide


def on_sheet(name: str) -> Column:
    """sheet names are compared in lower case."""
    return F.lower("sheet_name") == name.lower()


def named(column: str, text: str) -> Column:
    """contents or titles that contain a text, case-sensitively."""
    return F.contains(F.col(column), F.lit(text))


def with_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """the rows whose ``column`` is among the one-column ``ids``."""
    return rows.join(ids.toDF(column).distinct(), column, "left_semi")


def references_to_symbols() -> Column:
    """edges that refer to a symbol."""
    return F.col("relationship_type").isin(*REFERENCE_TYPES) & (F.col("target_type") == "Symbol")


def unembedded() -> Column:
    """Chunks that still need an embedding: none stored, content not blank."""
    return F.col("embedding").isNull() & ~X.is_blank(F.col("content"))


def incident(item_id: int, item_type: str) -> Column:
    return ((F.col("source_id") == item_id) & (F.col("source_type") == item_type)) | ((F.col("target_id") == item_id) & (F.col("target_type") == item_type))


class PathRefused(ValueError):
    """A path that may not be opened."""


def check_path(path: str | None, config: SecurityConfig | None = None, cwd: str | None = None) -> str:
    """The absolute path, or :class:`PathRefused` for a blank or malformed path, a restricted
    extension, or a place outside the allowed roots (lexical, case-insensitive)."""
    config = config or SecurityConfig()
    if not path or not path.strip():
        raise PathRefused("path is blank")
    if "\0" in path:
        raise PathRefused("path has invalid characters")
    base = os.path.abspath(cwd or os.getcwd())
    full = os.path.normpath(os.path.join(base, path))
    name = os.path.basename(full).lower()
    restricted = {X.dotted(e).lower() for e in config.restricted_extensions}
    if os.path.splitext(name)[1] in restricted or name in restricted:
        raise PathRefused("extension is restricted")
    if config.enforce_allowed_roots:
        roots = [os.path.normpath(os.path.join(base, r)) for r in (config.allowed_roots or [base])]
        inside = lambda r: full.lower() == r.lower() or full.lower().startswith(r.lower().rstrip(os.sep) + os.sep)
        if not any(map(inside, roots)):
            raise PathRefused("path is outside the allowed roots")
    return full
