"""Scalar column functions: tokens, previews, places, similarities, names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = 4
PREVIEW = 160
CUT_NOTICE = "\n\n... [Content truncated. Use line_start/line_end or page to read specific parts.]"


def token_estimate(text: Column) -> Column:
    """Code points divided by four, rounded up."""
    return F.ceil(F.length(text) / F.lit(float(TOKEN))).cast("int")


def sanitise(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(r"[^\s\p{Z}]")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a side is null, of another length or zero."""
    one, two = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(one, two, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    below = norm(one) * norm(two)
    return F.when((F.size(one) == F.size(two)) & (below > 0), dot / below)


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine with a known vector, whose norm is computed once and not for each row."""
    one, two = a.cast("array<double>"), F.array(*(F.lit(float(x)) for x in vector))
    dot = F.aggregate(F.zip_with(one, two, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    below = F.sqrt(F.aggregate(one, F.lit(0.0), lambda s, x: s + x * x)) * F.lit(math.sqrt(sum(float(x) * float(x) for x in vector)))
    return F.when((F.size(one) == len(vector)) & (below > 0), dot / below)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def preview(text: Column, most: int = PREVIEW) -> Column:
    """Line breaks as blanks, trimmed, cut to ``most`` characters that end in '...'."""
    flat = trim_all(F.translate(F.coalesce(text, F.lit("")), "\r\n", "  "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def location(page: Column, slide: Column, sheet: Column, line_start: Column, line_end: Column) -> Column:
    """The most specific place that is known: page, slide, sheet, lines, line; else null."""
    return (
        F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string")))
        .when(slide.isNotNull(), F.concat(F.lit("slide "), slide.cast("string")))
        .when(sheet.isNotNull() & (sheet != ""), F.concat(F.lit("sheet "), sheet))
        .when(line_start.isNotNull() & line_end.isNotNull() & (line_end > line_start), F.concat(F.lit("lines "), line_start.cast("string"), F.lit("-"), line_end.cast("string")))
        .when(line_start.isNotNull(), F.concat(F.lit("line "), line_start.cast("string")))
    )


def truncate(text: Column, most: int = 12_000, notice: str = CUT_NOTICE) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(notice))).otherwise(text)


def dotted(extension: str) -> str:
    """An extension with its leading dot."""
    return extension if extension.startswith(".") else f".{extension}"


def dotted_lower(extension: Column) -> Column:
    """An extension column in lower case with its leading dot; null stays null."""
    low = F.lower(extension)
    return F.when(low.isNull() | low.startswith(".") | (low == ""), low).otherwise(F.concat(F.lit("."), low))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    """Lower-case extension of a path with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def like_escaped(text: str) -> str:
    """A user's text as a literal part of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(column: Column, text: str, raw_pattern: bool = False) -> Column:
    """Case-insensitive substring; ``raw_pattern`` lets % and _ act as wildcards."""
    return column.ilike(f"%{text if raw_pattern else like_escaped(text)}%")


def half_even(x: Column, digits: int) -> Column:
    """Rounding half to even."""
    return F.bround(x, digits)


def indent(depth: Column) -> Column:
    return F.repeat(F.lit(" "), depth * 2)


def rrf_term(weight: float, rank: Column, k: int = 60) -> Column:
    """A ranking's part of a fused score, in percent; 0 where the item is missing from it."""
    return F.coalesce(F.lit(100.0 * weight) / (F.lit(float(k)) + rank), F.lit(0.0))
