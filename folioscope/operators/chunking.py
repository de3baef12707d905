"""Chunkers (K1 to K9): sections and symbols of parsed files become chunks.

The chunkers are plain functions over one parsed file, run inside the index job's Python stage;
those that expressions can state (fallback, parts, places) are also given as DataFrame operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

MAX_TOKENS = 512
# Document types that the paragraph chunker takes; parsers also emit others, which
# go to the fallback unless types are normalised.
PARAGRAPH_TYPES = ("text", "markdown", "csv", "json", "xml", "pdf", "docx", "xlsx", "pptx")
NORMALISED_TYPES = (*PARAGRAPH_TYPES, "document", "data", "doc", "xls", "ppt")

PLACE = ("page_number", "slide_number", "sheet_name", "line_start", "line_end")


def tokens(text: str) -> int:
    return -(-len(text) // X.TOKEN)


def paragraphs(text: Column) -> Column:
    """The pieces between blank lines, without empty ones."""
    return F.filter(F.split(text, r"\r\n\r\n|\n\n"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """The pieces between line ends and sentence ends, without empty ones."""
    return F.filter(F.split(text, r"\r\n|\n|\. "), lambda x: x != "")


def _atoms(text: str, most: int) -> Iterator[tuple[str, int, str]]:
    """Pieces with their tokens and what joins them to the piece before: whole paragraphs, and
    the lines and sentences of paragraphs that are too long."""
    for paragraph in re.split(r"\r\n\r\n|\n\n", text):
        if not paragraph:
            continue
        if tokens(paragraph) <= most:
            yield paragraph, tokens(paragraph), "\n\n"
        else:
            for part in re.split(r"\r\n|\n|\. ", paragraph):
                if part:
                    yield part, tokens(part), ". "


def greedy_pack(text: str, most: int = MAX_TOKENS) -> list[tuple[str, int]]:
    """K3: ``(content, tokens)`` of the chunks of one trimmed section.

    Pieces are added while the sum of their tokens stays within ``most``; a piece that alone is
    longer is a chunk of its own.  Tokens are the sum over the pieces, without the joints.
    """
    text = text.strip()
    if tokens(text) <= most:
        return [(text, tokens(text))] if text else []
    out: list[tuple[str, int]] = []
    held, total = "", 0
    for piece, size, joint in _atoms(text, most):
        if total and total + size > most:
            out.append((held.strip(), total))
            held, total = "", 0
        held += (joint if held else "") + piece
        total += size
    if held:
        out.append((held.strip(), total))
    return out


def _chunk(content: str, size: int, section: dict | None = None, **more) -> dict:
    place = {k: (section or {}).get(k) for k in PLACE}
    return {"content": content, "token_count": size, **place, "section_title": (section or {}).get("title"), "metadata": {}, **more}


def paragraph_chunker(parsed: dict, most: int = MAX_TOKENS) -> list[dict]:
    return [_chunk(c, n, s) for s in parsed["sections"] if (s["content"] or "").strip() for c, n in greedy_pack(s["content"], most)]


def code_chunker(parsed: dict, most: int = MAX_TOKENS) -> list[dict]:
    """K4: symbols that fit, or have no parts, whole; of the others a header and their parts.

    Text outside symbols isn't kept.  Without symbols: one trimmed chunk a section.  Titles, metadata
    keys and the five lines of a header are fixed values, part of the result.
    """
    symbols = parsed["symbols"]
    if not symbols:
        return [_chunk(s["content"].strip(), tokens(s["content"]), {k: v for k, v in s.items() if k in ("title", "line_start", "line_end")}) for s in parsed["sections"] if (s["content"] or "").strip()]
    has_parts = {s["parent"] for s in symbols if s["parent"] is not None}
    open_: set[int | None] = {None}  # symbols whose parts are chunks of their own
    out = []
    for at, s in enumerate(symbols):  # pre-order, so a parent is decided before its parts
        if s["parent"] not in open_:
            continue
        size, title = tokens(s["content"]), f"{s['kind']}: {s['name']}"
        meta = {"symbolName": s["name"], "symbolKind": s["kind"]}
        if size <= most or at not in has_parts:
            out.append(_chunk(s["content"].strip(), size, None, line_start=s["line_start"], line_end=s["line_end"], section_title=title, metadata={**meta, "namespace": s["namespace"] or ""}))
        else:
            open_.add(at)
            head = f"{s['signature'] or s['kind'] + ' ' + s['name']} (Line {s['line_start']}-{s['line_end']})"
            out.append(_chunk(head, tokens(head), None, line_start=s["line_start"], line_end=s["line_start"] + 5, section_title=title, metadata={**meta, "isHeader": "true"}))
    return out


def fallback_chunker(parsed: dict, most: int = MAX_TOKENS) -> list[dict]:
    """K5: one chunk a section that isn't blank, as it is, of any size."""
    return [_chunk(s["content"], tokens(s["content"]), s) for s in parsed["sections"] if (s["content"] or "").strip()]


Chunker = Callable[[dict, int], list[dict]]
#: (takes this document type?, chunker), the first that takes it chunks.
CHUNKERS: list[tuple[Callable[[str], bool], Chunker]] = [(lambda t: t == "code", code_chunker), (lambda t: t in PARAGRAPH_TYPES, paragraph_chunker)]


def chunk_parsed(parsed: dict, most: int = MAX_TOKENS, normalise_types: bool = False) -> list[dict]:
    """K2: dispatch by document type; ``normalise_types`` sends all texts through K3."""
    kind = parsed["document_type"]
    if normalise_types and kind in NORMALISED_TYPES:
        return paragraph_chunker(parsed, most)
    return next((c for takes, c in CHUNKERS if takes(kind)), fallback_chunker)(parsed, most)


# --- as DataFrame operators ------------------------------------------------------------------------


def fallback_chunks(documents: DataFrame) -> DataFrame:
    """K5 over documents ``(doc_id, text)`` that are one section each."""
    return documents.where(~X.is_blank(F.col("text"))).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), X.token_estimate(F.col("text")).alias("token_count"))


def greedy_chunks(documents: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """K3 over documents ``(doc_id, text)`` that are one section each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c, n) for k, t in zip(batch["doc_id"], batch["text"]) if t and t.strip() for i, (c, n) in enumerate(greedy_pack(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "token_count"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk_index int, content string, token_count int")


#: Chunk indexes of a block in which places are counted.
PLACE_BLOCK = 4096


def chunk_places(chunks: DataFrame, block: int = PLACE_BLOCK) -> DataFrame:
    """The 1-based place of each chunk in its document, by index, then id.

    Counted within blocks of indexes, to which the sizes of earlier blocks are added, so that no task
    orders all chunks of a large document.
    """
    rows = chunks.withColumn("_b", F.floor(F.coalesce("chunk_index", F.lit(-1)) / F.lit(block)))
    sizes = rows.groupBy("document_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("document_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("document_id").alias("_d"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("document_id", "_b").orderBy("chunk_index", "id"))
    placed = rows.withColumn("_own", own).join(starts, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn("place", (F.col("_start") + F.col("_own")).cast("int")).select(*chunks.columns, "place")
