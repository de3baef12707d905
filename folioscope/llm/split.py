"""Problem 2: oversized items cut at natural boundaries, with an overlap.

Balanced targets: the least number of pieces is computed, that many targets of equal length are
placed, each is snapped to the strongest boundary near it, and if any piece breaks the limit the
item is cut anew into one piece more.  So the pieces of an item have about the same length, and no
rest of a few words is left over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.cluster import spread

#: A token is so many code points, rounded up over the text.
TOKEN = 4
MAX_TOKENS = 512
OVERLAP_TOKENS = 48
#: How far from its target a cut may lie, as a share of a piece, for the strongest boundary.
REACH = 0.25

#: Boundaries from the strongest to the weakest; a cut lies at the end of a match.  Gap between
#: paragraphs, line before a heading or definition, line, sentence, clause, word.
BOUNDARIES = (
    re.compile(r"\n[ \t\r]*\n+|\f"),
    re.compile(r"\n(?=#{1,6} |(?:export |public |private |protected |internal |static |async )*(?:class|interface|function|def|struct|enum|namespace)\b|CREATE |GO\b)"),
    re.compile(r"[.!?;{}。！？]['\"”»)\]]*[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?]['\"”»)\]]*[ \t]+|[。！？]"),
    re.compile(r"[;:,)}\]][ \t]+|[；：、，]"),
    re.compile(r"[ \t]+|[^\w\s](?=\w)"),
)


def _snap(text: str, low: int, high: int, target: int) -> int | None:
    """The end, in ``[low, high]``, of the strongest boundary, of equals the nearest to target."""
    if low > high:
        return None
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(low - 200, 0), high):
            if low <= m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
        if best is not None:
            return best
    return None


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of a text, in code points.

    Each span is at most ``limit`` long, begins ``overlap`` before the end of the one before, and
    the spans cover the text.  A text within the limit is one span.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    step = limit - overlap
    count = 1 + -(-(n - limit) // step)
    while True:
        # A boundary far from its target may leave the later targets out of reach; then near ones only.
        for far in (True, False):
            if spans := _spans(text, limit, overlap, count, far):
                return spans
        count += 1


def _spans(text: str, limit: int, overlap: int, count: int, far: bool) -> list[tuple[int, int]] | None:
    """The spans of so many pieces, if the cuts work out; far: where no boundary is near its
    target, one anywhere that the piece may end goes before a cut without boundary."""
    n, step = len(text), limit - overlap
    size = (n + (count - 1) * overlap) / count
    spans, start, base, done = [], 0, 0, 0
    for k in range(1, count):
        reach = min(REACH * size, max(size - overlap - 1, 0))
        target = round(base + (k - done) * size - (k - done - 1) * overlap)
        last = start + limit
        # The rest must fit into the pieces that are left, and each piece must move on.
        least = max(start + overlap + 1, n - limit - (count - 1 - k) * step)
        low, high = max(least, round(target - reach)), min(last, n - 1, round(target + reach))
        cut = _snap(text, low, high, target)
        if cut is None:
            if low > high:
                return None
            cut = _snap(text, max(least, n + overlap - limit - (count - 1 - k) * step), min(last, n - 1), target) if far else None
            if cut is None:
                cut = min(max(target, low), high)  # no boundary at all: an even cut
            else:  # the rest is balanced anew
                base, done = cut - overlap, k
                size = (n - base + (count - k - 1) * overlap) / (count - k)
        spans.append((start, cut))
        start = cut - overlap
    return [*spans, (start, n)] if n - start <= limit else None


def split_oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of the chunks whose content has more than ``max_tokens``, whatever ``token_count`` says.

    Columns: ``chunk_id, piece_no`` (from 0), ``n_pieces, start`` (0-based code point),
    ``n_tokens, content, section_title, line_start``.  A piece's ``line_start`` is the number of
    its first line, counted from the chunk's; null where that is null.  Consecutive pieces share
    exactly ``overlap_tokens`` times four code points.  Null and short contents give no rows.  A
    chunk delivered twice is cut once.  Only oversized chunks leave the scan.
    """
    limit, overlap = max_tokens * TOKEN, overlap_tokens * TOKEN
    rows = (
        chunks.where(F.length("content") > limit)
        .select(F.col("id").cast("bigint").alias("chunk_id"), "content", F.col("section_title"), F.col("line_start").cast("int").alias("line_start"))
        .dropDuplicates(["chunk_id"])
    )
    schema = "chunk_id bigint, piece_no int, n_pieces int, start bigint, n_tokens int, content string, section_title string, line_start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            out = []
            for key, text, title, first in zip(*(c.to_pylist() for c in batch.columns)):
                spans = cut_points(text, limit, overlap)
                line, at = 0, 0
                for k, (a, b) in enumerate(spans):
                    line, at = line + text.count("\n", at, a), a
                    out.append((key, k, len(spans), a, -(-(b - a) // TOKEN), text[a:b], title, None if first is None else first + line))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return spread(rows, "chunk_id").mapInArrow(run, schema)


def split_ids(pieces: DataFrame) -> DataFrame:
    """``(chunk_id)`` of the chunks that were cut."""
    return pieces.where("n_pieces > 1").select("chunk_id").distinct()
