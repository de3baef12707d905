"""Token-budgeted context from search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

# The limits, and the layout of an excerpt, which callers look for.
CANDIDATES = 20
MAX_TOKENS = 16_000
FOOTER = "\n```\n"
CUT = "\n... [truncated to fit token budget]\n"
SPARE, WORTH = 100, 200


def ranked(results: DataFrame) -> DataFrame:
    """Search results with their rank, as candidates of :func:`excerpts`; a result list is short."""
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return results.select("chunk_id", F.row_number().over(best).alias("rank"), "filename", "path", "section_title", "location", "score")


def first_of_beginnings(rows: DataFrame, order: str, beginning: int = 80) -> DataFrame:
    """Of the rows whose ``content`` begins alike the one that comes first in ``order``; an
    aggregate, so a beginning that many share is reduced before the shuffle."""
    held = rows.columns
    first = rows.groupBy(F.substring("content", 1, beginning).alias("_p")).agg(F.min_by(F.struct(*held), order).alias("_r"))
    return first.select(*(F.col(f"_r.{c}") for c in held))


def first_edges(edges: DataFrame, end: str, each: int = 3) -> DataFrame:
    """At most ``each`` edges of each document at that end (source or target), smallest ids
    first, with their ``position``."""
    n = F.row_number().over(Window.partitionBy(f"{end}_id").orderBy("id"))
    return edges.where(F.col(f"{end}_type") == "Document").withColumn("position", n).where(F.col("position") <= each)


def excerpts(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates ``(chunk_id, rank, filename, path, section_title, location, score)`` with the
    header and text of their excerpt; of equal beginnings (80 characters) the best rank stays."""
    c = chunks.select(F.col("id").alias("chunk_id"), "content").join(F.broadcast(candidates.select("chunk_id")), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    rows = F.broadcast(candidates).join(c, "chunk_id")
    head = F.concat(
        F.lit("\n### ["), F.col("filename"), F.lit("] "), F.coalesce("section_title", F.lit("Excerpt")), F.lit("\nLocation: "), F.coalesce("location", F.lit("")),
        F.lit(" | Path: "), F.col("path"), F.lit(" | Score: "), F.format_number("score", 3), F.lit("\n```\n"),
    )
    text = X.trim_all(F.coalesce("content", F.lit("")))
    shown = first_of_beginnings(rows.select("chunk_id", "rank", "filename", "content", head.alias("header"), text.alias("text")), "rank")
    return shown.drop("content")


def pack(rows: DataFrame, max_chars: int, used: int = 0) -> DataFrame:
    """The excerpts that fit into ``max_chars`` after ``used``, in rank order: ``(chunk_id, rank,
    filename, excerpt, truncated, end_offset)``.

    All until the first that doesn't fit; that one is cut if more than 200 characters would be
    left for its text.  Lengths are positive, so the running sum rises and this equals the loop.
    """
    # Candidates are a top-k result, so one partition for the running sum is bounded.
    order = Window.partitionBy(F.lit(1)).orderBy("rank")
    length = F.length("header") + F.length("text") + F.lit(len(FOOTER))
    summed = rows.withColumn("_len", length).withColumn("_end", F.lit(used) + F.sum("_len").over(order))
    before = F.col("_end") - F.col("_len")
    room = F.lit(max_chars) - before - F.length("header") - F.lit(len(FOOTER) + SPARE)
    over = F.col("_end") > max_chars
    first_over = F.sum(F.when(over, 1).otherwise(0)).over(order) == 1
    marked = summed.withColumn("_over", over).withColumn("_cut", over & first_over & (room > WORTH)).withColumn("_room", room)
    whole = F.concat("header", "text", F.lit(FOOTER))
    cut = F.concat(F.col("header"), F.expr("substring(text, 1, _room)"), F.lit(CUT), F.lit(FOOTER))
    kept = marked.where(~F.col("_over") | F.col("_cut"))
    return kept.select("chunk_id", "rank", "filename", F.when(F.col("_cut"), cut).otherwise(whole).alias("excerpt"), F.col("_cut").alias("truncated"), F.least(F.col("_end"), F.lit(max_chars)).cast("bigint").alias("end_offset"))


def relationship_lines(edges: DataFrame, documents: DataFrame, doc_ids: DataFrame, each: int = 3) -> DataFrame:
    """Of the documents ``(doc_id, filename, rank)`` at most ``each`` outgoing and ``each``
    incoming edges (smallest ids first), as lines ``(rank, direction, position, line)``."""
    d = F.broadcast(doc_ids.select("doc_id", F.col("filename").alias("_f"), "rank"))
    loop = (F.col("source_type") == "Document") & (F.col("target_type") == "Document") & (F.col("source_id") == F.col("target_id"))
    parts = []
    for end, other, direction, rows in (("source", "target", "outgoing", edges), ("target", "source", "incoming", edges.where(~loop))):
        own = rows.join(d, F.col(f"{end}_id") == F.col("doc_id"))
        parts.append(first_edges(own, end, each).select("rank", "_f", F.lit(direction).alias("direction"), "position", "relationship_type", F.concat_ws(" #", f"{other}_type", F.col(f"{other}_id").cast("string")).alias("other")))
    top = parts[0].unionByName(parts[1])
    arrow = F.concat(F.lit(" --("), F.col("relationship_type"), F.lit(")--> "))
    line = F.when(F.col("direction") == "outgoing", F.concat(F.lit("• ["), F.col("_f"), F.lit("]"), arrow, F.lit("["), F.col("other"), F.lit("]"))).otherwise(F.concat(F.lit("• ["), F.col("other"), F.lit("]"), arrow, F.lit("["), F.col("_f"), F.lit("]")))
    return top.select("rank", "direction", "position", line.alias("line"))
