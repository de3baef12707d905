"""Building blocks of the SQL that the registered queries are compared with."""

CHUNKS = "(SELECT DISTINCT ON (id) * FROM document_chunks)"
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"
LOCATION = """CASE WHEN page_number IS NOT NULL THEN 'page ' || page_number
  WHEN slide_number IS NOT NULL THEN 'slide ' || slide_number
  WHEN sheet_name IS NOT NULL AND sheet_name <> '' THEN 'sheet ' || sheet_name
  WHEN line_start IS NOT NULL AND line_end > line_start THEN 'lines ' || line_start || '-' || line_end
  WHEN line_start IS NOT NULL THEN 'line ' || line_start END"""
TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
# The forms of the terms that the registered searches ask for, written out by hand.
_FORMS = {"index": "index indexs indexes indexed indexing indexings indexer indexers indexable", "schema": "schema schemas", "replica": "replica replicas", "warehous": "warehouse warehouses warehoused warehousing"}
STEMMED = "list_transform(" + TOKENS + ", lambda x: CASE " + " ".join(f"WHEN x IN ({', '.join(repr(w) for w in words.split())}) THEN '{term}'" for term, words in _FORMS.items()) + " ELSE '' END)"


def cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda z: z::DOUBLE * z::DOUBLE)))"
    return f"({dot} / ({norm(a)} * {norm(b)}))"


def fts_one(word: str, tokens: str = TOKENS) -> str:
    """Chunks with a word: id, document_id, score 0.1 an occurrence."""
    return f"""SELECT id AS chunk_id, document_id, 0.1 * len(list_filter(w, lambda x: x = '{word}')) AS fts_rank
      FROM (SELECT id, document_id, {tokens} AS w FROM {CHUNKS} WHERE content IS NOT NULL) WHERE list_contains(w, '{word}')"""


def fts_two(a: str, b: str, tokens: str = TOKENS) -> str:
    """Chunks with both words: 0.1 / distance for each pair of neighbouring, differing hits."""
    return f"""SELECT chunk_id, document_id, coalesce(sum(CASE WHEN t <> p THEN 0.1 / (i - q) ELSE 0 END), 0) AS fts_rank
      FROM (SELECT chunk_id, document_id, t, i, lag(t) OVER (PARTITION BY chunk_id ORDER BY i) AS p, lag(i) OVER (PARTITION BY chunk_id ORDER BY i) AS q
        FROM (SELECT id AS chunk_id, document_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i
          FROM (SELECT id, document_id, {tokens} AS w FROM {CHUNKS} WHERE content IS NOT NULL)
          WHERE list_contains(w, '{a}') AND list_contains(w, '{b}')) WHERE t IN ('{a}', '{b}'))
      GROUP BY chunk_id, document_id"""


def top(rows: str, score: str, n: int, where: str = "TRUE", columns: str = "d.path, d.filename, d.document_type") -> str:
    return f"""SELECT r.chunk_id, r.document_id, {columns}, r.{score}
      FROM ({rows}) r JOIN documents d ON d.doc_id = r.document_id WHERE {where} ORDER BY round(r.{score}, 9) DESC, r.chunk_id LIMIT {n}"""
