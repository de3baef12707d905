"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import read_table
from folioscope.llm import bpe, handwritten, neardup, packing, quality, secrets, split, vectors

Query = Callable[[SparkSession, str], DataFrame]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_places(read_table(spark, sf_dir, "document_chunks"), read_table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mutual_pairs(vectors.similar_neighbours(read_table(spark, sf_dir, "document_chunks"), least=0.9))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours_of_queries(read_table(spark, sf_dir, "document_chunks"), F.col("id") % 20 == 0)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(read_table(spark, sf_dir, "document_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_ids(p2_pieces(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_lines(_places(spark, sf_dir))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted_chunks(read_table(spark, sf_dir, "document_chunks"), _places(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(read_table(spark, sf_dir, "document_chunks"))
    return neardup.expand_pairs(members, links)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_duplicates(read_table(spark, sf_dir, "document_chunks"))
    return neardup.groups(members, links)


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.unwritten_files(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "third_party_packages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_reasons(spark, sf_dir).select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words")).select("doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p3_found": p3_found,
        "p3_redacted": p3_redacted,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_reasons": p5_reasons,
        "p6_ids": p6_ids,
        "p7_containers": p7_containers,
        "p8_found": p8_found,
        "p8_stats": p8_stats,
    }


_P8 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
    regexp_extract_all(regexp_replace(lower(t), '([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+') AS w,
    length(regexp_replace(t, '[\s\p{Z}\x0B]+', '', 'g')) AS ink,
    length(regexp_replace(t, '[\s\p{Z}\x0B\p{L}\p{M}\p{N}]+', '', 'g')) AS symbols,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\x0B]'))) AS n_lines,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.!?…:;,。！？；：、][\x27"»”’)\]]*[ \t\r]*$'))) AS punctuated,
    len(regexp_extract_all(t, '[\p{L}\p{N}][\x27"»”’)\]%]*[.!?](?:[\s\x0B]|$)|[。！？]')) - len(regexp_extract_all(t, '(?m)^[ \t]*[0-9]+\.[ \t]')) AS ends
  FROM t
),
c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words),
n AS (
  SELECT doc_id, w.*, len(w) AS n, length(list_aggregate(w, 'string_agg', '')) AS letters,
    len(list_filter(w, lambda x: list_contains(c.common, x))) AS common_n
  FROM w, c
)
"""


_P4 = r"""WITH w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT id, content FROM document_chunks WHERE content IS NOT NULL)),
        s AS (SELECT DISTINCT id, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
        j AS (SELECT id_a, id_b, both_ / (x.n + y.n - both_) AS j FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE both_ >= 0.6 * (x.n + y.n - both_))
        """


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
        WITH v AS (SELECT DISTINCT id, embedding FROM document_chunks WHERE len(embedding) = 64
            AND isfinite(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))) AND list_sum(list_transform(embedding, lambda z: abs(z::DOUBLE))) > 0),
        e AS (SELECT id, embedding::DOUBLE[64] AS v FROM v),
        s AS (SELECT a.id AS x, b.id AS y, array_cosine_similarity(a.v, b.v) AS c FROM e a, e b WHERE a.id <> b.id),
        t AS (SELECT x, y, c FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 12) DESC, y) AS n FROM s) WHERE n <= 10 AND c >= 0.9)
        SELECT a.x AS id_a, a.y AS id_b FROM t a JOIN t b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y""",
        "p4_found": _P4 + "SELECT id_a, id_b FROM j",
        "p4_groups": "WITH RECURSIVE" + _P4.removeprefix("WITH") + """
        , b AS (SELECT id_a AS x, id_b AS y, j FROM j UNION ALL SELECT id_b, id_a, j FROM j),
        m AS (SELECT n.id, least(n.id, coalesce(min(b.y), n.id)) AS rep FROM n LEFT JOIN b ON b.x = n.id AND b.j = 1 GROUP BY n.id),
        e AS (SELECT DISTINCT p.rep AS x, q.rep AS y FROM b JOIN m p ON p.id = b.x JOIN m q ON q.id = b.y WHERE p.rep <> q.rep),
        r(v, l) AS (SELECT x, x FROM e UNION SELECT e.y, r.l FROM r JOIN e ON e.x = r.v),
        l AS (SELECT v, min(l) AS l FROM r GROUP BY v),
        c AS (SELECT rep, count(*) AS n FROM m GROUP BY rep),
        d AS (SELECT x, count(*) AS n FROM e GROUP BY x)
        SELECT m.id AS chunk_id, coalesce(l.l, m.rep) AS group_id, coalesce(d.n, 0) AS n_links FROM m JOIN c ON c.rep = m.rep LEFT JOIN l ON l.v = m.rep LEFT JOIN d ON d.x = m.rep WHERE c.n > 1 OR l.l IS NOT NULL""",
        # By a threshold set by hand between prose and the rest, not by the learned rules.
        "p8_found": _P8
        + """
        SELECT n.doc_id FROM n JOIN documents d USING (doc_id) WHERE d.document_type IN ('document', 'pdf', 'docx', 'doc') AND regexp_matches(d.text, '[^\\s\\p{Z}\\x{FEFF}]')
          AND (ends < 0.02 * n OR symbols > 0.5 * ink)""",
        "p2_found": "SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE ceil(length(content) / 4.0) > 512",
        "p8_stats": _P8
        + """
        SELECT doc_id, CAST(n AS BIGINT) AS word_count,
          CASE WHEN n > 0 THEN round(letters / n, 6) ELSE 0.0 END AS mean_word_length,
          CASE WHEN ink > 0 THEN round(symbols / ink, 6) ELSE 0.0 END AS symbol_ratio,
          CASE WHEN n_lines > 0 THEN round(punctuated / n_lines, 6) ELSE 0.0 END AS punctuated_lines,
          CASE WHEN n > 0 THEN round(common_n / n, 6) ELSE 0.0 END AS common_words,
          CASE WHEN ink > 0 THEN round(digits / ink, 6) ELSE 0.0 END AS digit_ratio,
          CASE WHEN n_lines > 0 THEN round(n / n_lines, 6) ELSE 0.0 END AS words_per_line,
          CASE WHEN n > 0 THEN round(ends / n, 6) ELSE 0.0 END AS sentence_ends
        FROM n""",
    }
