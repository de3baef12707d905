"""Full-text, semantic and hybrid top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.cluster import spread
from folioscope.functions import text as X
from folioscope.functions.analyze import WebQuery, english_postings, parse_web_query, positions, simple_tokens, word_parts
from folioscope.functions.rank import cover_density, headline, matches
from folioscope.operators.filters import distinct_chunks, document_filter

PLACE = ("page_number", "slide_number", "sheet_name", "line_start", "line_end")
RESULT_COLUMNS = ["chunk_id", "document_id", "path", "filename", "document_type", "section_title", "location", "preview", "score"]


@dataclass
class SearchQuery:
    text: str
    limit: int = 10
    document_type: str | None = None
    extension: str | None = None
    path_prefix: str | None = None

    @property
    def top(self) -> int:
        return self.limit if self.limit > 0 else 10


def _documents(documents: DataFrame, query: SearchQuery) -> DataFrame:
    return documents.where(document_filter(query.document_type, query.extension, query.path_prefix)).select(F.col("doc_id").alias("document_id"), "path", "filename", "document_type")


def _no_rows(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def build_postings(chunks: DataFrame, analyzer: str = "english") -> DataFrame:
    """``(term, chunk_id, document_id, positions)`` of all chunks; write it sorted or bucketed by
    ``term`` and a query reads only its own terms."""
    rows = chunks.select("id", "document_id", "content").where(F.col("content").isNotNull())
    if analyzer == "simple":
        each = distinct_chunks(rows).select(F.col("id").alias("chunk_id"), "document_id", F.posexplode(simple_tokens(F.col("content"))).alias("at", "term"))
        return each.groupBy("term", "chunk_id", "document_id").agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))
    held = distinct_chunks(rows).select(F.col("id").alias("chunk_id"), "document_id", F.explode(english_postings("content")).alias("p"))
    return held.select("p.term", "chunk_id", "document_id", "p.positions")


def _simple_score(query: WebQuery, tokens: Column) -> Column:
    """Cover density of a conjunction of one or two plain words, as an expression.

    One word: 0.1 times its occurrences.  Two words: neighbours, among the occurrences of both,
    that differ are the minimal covers, each worth 0.1 / distance."""
    words = query.words
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: t == words[0])) * F.lit(0.1)
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    hits = F.filter(numbered, lambda s: s["t"].isin(words))
    steps = F.zip_with(F.slice(hits, 1, F.greatest(F.size(hits) - 1, F.lit(0))), F.slice(hits, 2, F.greatest(F.size(hits) - 1, F.lit(1))), lambda a, b: F.when(a["t"] != b["t"], F.lit(0.1) / (b["i"] - a["i"])).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def full_text_scores(chunks: DataFrame, query: WebQuery, analyzer: str = "english") -> DataFrame:
    """``(chunk_id, document_id, fts_rank)`` of the matching chunks.

    Without postings: a cheap JVM filter drops chunks that can't match before anything is tokenised
    in Python.  Plain conjunctions of up to two words under ``simple`` need no Python at all.
    """
    rows = chunks.select("id", "document_id", "content").where(F.col("content").isNotNull())
    plain = analyzer == "simple" and len(query.groups) == 1 and len(query.groups[0]) == len(query.words) <= 2 and all(not p.negated and len(p.terms) == 1 for p in query.groups[0])
    if plain:
        low = F.lower("content")
        for w in query.words:
            rows = rows.where(low.contains(w))
        tokens = spread(rows, "id").select("id", "document_id", simple_tokens(F.col("content")).alias("_w"))
        for w in query.words:
            tokens = tokens.where(F.array_contains("_w", w))
        scored = tokens.select(F.col("id").alias("chunk_id"), "document_id", _simple_score(query, F.col("_w")).alias("fts_rank"))
        return scored.dropDuplicates(["chunk_id"])

    # Each alternative needs all of its positive terms, and so a part of a word of each.
    some = F.lit(False)
    for group in query.groups:
        on = F.lit(True)
        for p in group:
            if not p.negated:
                for t, _ in p.terms:
                    on &= reduce(Column.__or__, (F.lower("content").contains(x) for x in word_parts(t, analyzer)))
        some |= on

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [positions(t, analyzer) for t in batch["content"]]
            keep = [matches(query, h) for h in held]
            out = batch.loc[keep, ["id", "document_id"]].rename(columns={"id": "chunk_id"})
            out["fts_rank"] = [cover_density(query, h) for h, k in zip(held, keep) if k]
            yield out

    return spread(rows.where(some), "id").mapInPandas(run, "chunk_id bigint, document_id bigint, fts_rank double").dropDuplicates(["chunk_id"])


#: Term buckets of stored postings.
TERM_BUCKETS = 64


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def posting_scores(postings: DataFrame, query: WebQuery) -> DataFrame:
    """``(chunk_id, document_id, version, fts_rank)`` of the matching chunks, from the postings
    ``(bucket, term, chunk_id, document_id, version, positions)`` of an index.

    Only the buckets and terms of the query are read.  Chunks that lack a term which every
    alternative needs are dropped as soon as their terms are together, before anything is ranked.
    """
    words = query.all_words
    spark = postings.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(term_bucket(F.col("term"))).distinct().collect()]
    hits = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
    held = hits.groupBy("chunk_id", "document_id", "version").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "positions")))).alias("held"))
    some = F.lit(False)
    for group in query.groups:
        needed = {t for p in group if not p.negated for t, _ in p.terms}
        some |= reduce(Column.__and__, (F.map_contains_key("held", t) for t in sorted(needed)), F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{t: list(at) for t, at in dict(h).items()} for h in batch["held"]]
            keep = [matches(query, h) for h in found]
            out = batch.loc[keep, ["chunk_id", "document_id", "version"]]
            yield out.assign(fts_rank=[cover_density(query, h) for h, k in zip(found, keep) if k])

    return held.where(some).mapInPandas(run, "chunk_id bigint, document_id bigint, version bigint, fts_rank double")


def _dress(top: DataFrame, chunks: DataFrame, documents: DataFrame, headline_of: Callable | None = None, preview: int = X.PREVIEW) -> DataFrame:
    """Titles, places and previews of the few result rows ``(chunk_id, score, ...)``."""
    parts = distinct_chunks(chunks.select(F.col("id"), "content", "section_title", *PLACE).join(F.broadcast(top.select(F.col("chunk_id").alias("id"))), "id", "left_semi")).withColumnRenamed("id", "chunk_id")
    shown = X.preview(F.col("content"), preview)
    if headline_of is not None:
        lead = headline_of(F.col("content"))
        shown = F.when(lead != "", lead).otherwise(shown)
    return F.broadcast(top).join(parts, "chunk_id").withColumn("preview", shown).withColumn("location", X.location(*(F.col(c) for c in PLACE)))


def _headline_udf(query: WebQuery, analyzer: str):
    @F.pandas_udf(T.StringType())
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda t: headline(query, t, analyzer))

    return run


def text_top(chunks: DataFrame, documents: DataFrame, query: SearchQuery, analyzer: str = "english", limit: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """The best chunks by text alone: ``chunk_id, document_id, path, filename, document_type,
    fts_rank``.  Ties go to the smaller chunk id.

    With ``postings`` (those of :func:`posting_scores`, of the same analyser) contents aren't read;
    postings of another version than the document's are stale and left out.
    """
    parsed = parse_web_query(query.text, analyzer)
    docs = _documents(documents, query)
    if not (query.text or "").strip() or not parsed.groups:
        empty = _no_rows(chunks.select(F.col("id").alias("chunk_id"), "document_id")).withColumn("fts_rank", F.lit(0.0))
        return empty.join(docs, "document_id").select("chunk_id", "document_id", "path", "filename", "document_type", "fts_rank")
    if postings is None:
        joined = full_text_scores(chunks, parsed, analyzer).join(docs, "document_id")
    else:
        now = documents.select(F.col("doc_id").alias("document_id"), version_of(F.col("hash")).alias("version"))
        joined = posting_scores(postings, parsed).join(now, ["document_id", "version"]).join(docs, "document_id")
    joined = joined.select("chunk_id", "document_id", "path", "filename", "document_type", "fts_rank")
    return joined.orderBy(F.desc(F.round("fts_rank", 9)), "chunk_id").limit(limit or query.top)


def version_of(hash_: Column) -> Column:
    """The version of a document by its content hash."""
    return F.xxhash64(hash_)


def text_search(chunks: DataFrame, documents: DataFrame, query: SearchQuery, analyzer: str = "english", postings: DataFrame | None = None, preview: int = X.PREVIEW) -> DataFrame:
    """``RESULT_COLUMNS`` plus ``score_components``; score is the cover density."""
    parsed = parse_web_query(query.text, analyzer)
    top = text_top(chunks, documents, query, analyzer, None, postings).withColumn("score", F.col("fts_rank"))
    dressed = _dress(top, chunks, documents, _headline_udf(parsed, analyzer) if parsed.groups else None, preview)
    return dressed.select(*RESULT_COLUMNS, F.create_map(F.lit("fts_rank"), F.col("fts_rank")).alias("score_components")).orderBy(F.desc(F.round("score", 9)), "chunk_id")


#: How often a chunk may be delivered.
COPIES = 2


def semantic_top(chunks: DataFrame, documents: DataFrame, query: SearchQuery, vector: list[float], limit: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """The best chunks by cosine with ``vector``; chunks whose embedding is null, of another
    length, zero or not finite are no candidates.

    ``near``: rows of inverted lists (``vector_index.candidates``) instead of all chunks; those of
    another version than the document's are stale and left out.  The search is then approximate.
    """
    held = chunks.withColumnRenamed("id", "chunk_id") if near is None else near.join(documents.select(F.col("doc_id").alias("document_id"), version_of(F.col("hash")).alias("version")), ["document_id", "version"], "left_semi")
    rows = held.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(vector))).select("chunk_id", "document_id", X.cosine_to(F.col("embedding"), vector).alias("similarity"))
    scored = rows.where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    joined = scored.join(_documents(documents, query), "document_id").select("chunk_id", "document_id", "path", "filename", "document_type", "similarity")
    # Copies of a row sort next to each other, so the best of all, with room for a copy of each,
    # are enough; no other row is shuffled to find copies.
    best, n = [F.desc(F.round("similarity", 9)), F.asc("chunk_id")], limit or query.top
    return joined.orderBy(*best).limit(n * COPIES).dropDuplicates(["chunk_id"]).orderBy(*best).limit(n)


def semantic_search(chunks: DataFrame, documents: DataFrame, query: SearchQuery, vector: list[float], preview: int = X.PREVIEW, near: DataFrame | None = None) -> DataFrame:
    """R2: score is the cosine clamped to [0, 1]; the component keeps the raw value."""
    top = semantic_top(chunks, documents, query, vector, near=near).withColumn("score", X.clamp01(F.col("similarity")))
    if not (query.text or "").strip():
        top = _no_rows(top)
    return _dress(top, chunks, documents, None, preview).select(*RESULT_COLUMNS, F.create_map(F.lit("semantic_score"), F.col("similarity")).alias("score_components")).orderBy(F.desc(F.round("score", 9)), "chunk_id")


def fuse(text_rows: DataFrame, semantic_rows: DataFrame, weights: tuple[float, float] = (0.4, 0.6), k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two short ranked lists, full outer by chunk.

    ``text_rows`` needs ``chunk_id, document_id, fts_rank``, ``semantic_rows`` ``chunk_id,
    document_id, similarity``.  Ranks are 1-based by score (9 digits), then chunk id.  Columns:
    ``chunk_id, document_id, text_pos, semantic_pos, fts_score, semantic_score, score``.
    """
    # Both lists are top-k results, so one partition for their windows is bounded.
    by = lambda c: Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(c, 9)), "chunk_id")
    t = text_rows.select("chunk_id", "document_id", F.col("fts_rank").alias("fts_score"), F.row_number().over(by("fts_rank")).alias("text_pos"))
    s = semantic_rows.select("chunk_id", F.col("document_id").alias("_d"), X.clamp01(F.col("similarity")).alias("semantic_score"), F.row_number().over(by("similarity")).alias("semantic_pos"))
    both = t.join(s, "chunk_id", "full_outer")
    return both.select(
        "chunk_id",
        F.coalesce("document_id", "_d").alias("document_id"),
        "text_pos",
        "semantic_pos",
        F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        (X.rrf_term(weights[0], F.col("text_pos"), k) + X.rrf_term(weights[1], F.col("semantic_pos"), k)).alias("score"),
    )


def fused_order() -> list:
    """Best score first; of equals those found by text first, in its order."""
    return [F.desc(F.round("score", 9)), F.asc_nulls_last("text_pos"), F.asc_nulls_last("semantic_pos"), F.asc("chunk_id")]


def hybrid_top(chunks: DataFrame, documents: DataFrame, query: SearchQuery, vector: list[float], analyzer: str = "english", weights: tuple[float, float] = (0.4, 0.6), k: int = 60, postings: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    pool = max(3 * query.top, 30)
    fused = fuse(text_top(chunks, documents, query, analyzer, pool, postings), semantic_top(chunks, documents, query, vector, pool, near), weights, k)
    return fused.orderBy(*fused_order()).limit(query.top)


def hybrid_search(chunks: DataFrame, documents: DataFrame, query: SearchQuery, vector: list[float] | None, analyzer: str = "english", weights: tuple[float, float] = (0.4, 0.6), k: int = 60, postings: DataFrame | None = None, preview: int = X.PREVIEW, near: DataFrame | None = None) -> DataFrame:
    """Text and semantic search fused; without a vector (no provider) it is R1.

    The score is a hundred times the fused sum.  A chunk found by text shows the text preview.
    """
    if vector is None or not (query.text or "").strip():
        return text_search(chunks, documents, query, analyzer, postings, preview)
    parsed = parse_web_query(query.text, analyzer)
    fused = hybrid_top(chunks, documents, query, vector, analyzer, weights, k, postings, near)
    named = F.broadcast(fused).join(documents.select(F.col("doc_id").alias("document_id"), "path", "filename", "document_type"), "document_id")
    dressed = _dress(named, chunks, documents, None, preview)
    if parsed.groups:
        lead = _headline_udf(parsed, analyzer)(F.col("content"))
        dressed = dressed.withColumn("preview", F.when(F.col("text_pos").isNotNull() & (lead != ""), lead).otherwise(F.col("preview")))
    parts = F.create_map(F.lit("rrf_score"), F.col("score") / 100, F.lit("fts_score"), F.col("fts_score"), F.lit("semantic_score"), F.col("semantic_score"))
    return dressed.orderBy(*fused_order()).select(*RESULT_COLUMNS, parts.alias("score_components"))
