"""Shared SQL pieces of the checking queries: the logical tables, restated in ANSI SQL."""

from __future__ import annotations

from corpusloom.functions.text import WHITESPACE

BLANKS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
START = "TIMESTAMP '2024-01-01 00:00:00'"
WORDS = r"'[\p{L}\p{N}_]+'"

DOCS = f"""docs AS (
  SELECT doc_id, source AS kb_id, 'doc_' || doc_id || '.md' AS source,
         trim(text, {BLANKS}) AS text
  FROM documents WHERE length(trim(text, {BLANKS})) > 0)"""

KBS = f"""kbs AS (
  SELECT source AS kb_id, 'kb of ' || source AS name, '' AS description,
         {START} + to_minutes(CAST(min(doc_id) AS INTEGER)) AS created_at
  FROM documents GROUP BY source)"""

REGISTRY = f"""registry AS (
  SELECT doc_id, source AS kb_id, 'doc_' || doc_id || '.md' AS filename, n_chars AS file_size,
         CAST(n_chars // 450 AS BIGINT) AS chunk_count,
         CASE WHEN doc_id % 10 < 7 THEN 'ready' WHEN doc_id % 10 = 7 THEN 'processing'
              WHEN doc_id % 10 = 8 THEN 'empty' ELSE 'error' END AS status,
         {START} + to_minutes(CAST(doc_id AS INTEGER)) AS created_at
  FROM documents)"""


def _end(start: str, size: int) -> str:
    """End of the window at ``start``; ``r`` is the reversed look-back text (100 long)."""
    marks = ["chr(10) || chr(10)", "chr(10)", "'。'", "'；'", "'，'", "'.'", "';'", "','"]
    cuts = " ".join(
        f"WHEN strpos(r, {m}) > 0 THEN {start} + {size} - strpos(r, {m}) + 1" for m in marks)
    return (f"CASE WHEN {start} + {size} >= n THEN {start} + {size} {cuts} "
            f"ELSE {start} + {size} END")


def windows(size: int = 500, overlap: int = 50, docs: str = "docs", name: str = "chunks") -> str:
    """CTEs ending in ``name`` (doc_id, kb_id, source, chunk_index, content, chunk_id)."""
    back = f"reverse(substring(text, s + {size - 99}, 100))"
    return f"""{name}_w AS (
  SELECT doc_id, n, text, k, s, {_end('s', size)} AS e
  FROM (SELECT doc_id, length(text) AS n, text, 0 AS k, 0 AS s,
               reverse(substring(text, {size - 99}, 100)) AS r
        FROM {docs} WHERE length(text) > {size})
  UNION ALL
  SELECT doc_id, n, text, k, s, {_end('s', size)} AS e
  FROM (SELECT doc_id, n, text, k + 1 AS k, s, {back} AS r
        FROM (SELECT doc_id, n, text, k, e - {overlap} AS s FROM {name}_w) WHERE s < n)),
{name}_p AS (
  SELECT doc_id, k, trim(substring(text, s + 1, e - s), {BLANKS}) AS content FROM {name}_w
  UNION ALL SELECT doc_id, 0, text FROM {docs} WHERE length(text) <= {size}),
{name} AS MATERIALIZED (
  SELECT d.doc_id, d.kb_id, d.source, p.content,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY p.k) - 1 AS chunk_index,
         d.kb_id || '#' || d.doc_id || '#0#' || (row_number() OVER (PARTITION BY d.doc_id ORDER BY p.k) - 1)
           AS chunk_id
  FROM {name}_p p JOIN {docs} d USING (doc_id) WHERE length(p.content) > 0)"""


CHUNKS = f"{DOCS},\n{windows()}"

CORPUS_QUESTIONS = """questions AS (
  SELECT item_id AS query_id, 'corpus' AS kb_id, text FROM benchmark)"""

USER_QUESTIONS = """questions AS (
  SELECT conv_id * 100 + turn AS query_id, 'src' || (conv_id % 25) AS kb_id, text
  FROM conversations WHERE role = 'user')"""


def lexicon(kb: str) -> str:
    """CTEs tokens, corpus_stats and terms; ``kb`` is an expression over a chunk row."""
    return f"""tokens AS MATERIALIZED (
  SELECT {kb} AS kb_id, chunk_id, regexp_extract_all(lower(content), {WORDS}) AS tokens
  FROM chunks),
corpus_stats AS (
  SELECT kb_id, count(*) AS n_chunks, avg(len(tokens)) AS avg_len FROM tokens GROUP BY kb_id),
postings AS MATERIALIZED (
  SELECT kb_id, chunk_id, term, count(*) AS tf
  FROM (SELECT kb_id, chunk_id, unnest(tokens) AS term FROM tokens) GROUP BY ALL),
raw_terms AS (
  SELECT kb_id, term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw
  FROM (SELECT kb_id, term, count(*) AS df FROM postings GROUP BY ALL)
  JOIN corpus_stats USING (kb_id)),
terms AS MATERIALIZED (
  SELECT kb_id, term, df,
         CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY kb_id) ELSE raw END AS idf
  FROM raw_terms)"""


def keyword_hits(k: int, name: str = "keyword_hits") -> str:
    """CTE of BM25 hits from questions, postings, terms and corpus_stats."""
    return f"""asked AS (
  SELECT query_id, kb_id, term, count(*) AS qf FROM (
    SELECT query_id, kb_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term
    FROM questions) GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM (
      SELECT a.query_id, p.chunk_id, round(sum(
        a.qf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(k.tokens) / c.avg_len))), 6)
        AS score
      FROM asked a JOIN terms t ON t.kb_id = a.kb_id AND t.term = a.term
      JOIN postings p ON p.kb_id = a.kb_id AND p.term = a.term
      JOIN tokens k ON k.chunk_id = p.chunk_id AND k.kb_id = p.kb_id
      JOIN corpus_stats c ON c.kb_id = a.kb_id
      GROUP BY a.query_id, p.chunk_id))
  WHERE rank <= {k})"""


_SLOT = "CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 256"


def text_vectors() -> str:
    """CTEs chunk_vec and question_vec (id, slot, w) from postings and questions."""
    return f"""slot_tf AS MATERIALIZED (
  SELECT kb_id, chunk_id, {_SLOT} AS slot, sum(tf) AS n FROM postings GROUP BY ALL),
slot_idf AS MATERIALIZED (
  SELECT f.kb_id, f.slot, ln((c.n_chunks + 1.0) / (f.df + 1.0)) + 1.0 AS idf
  FROM (SELECT kb_id, slot, count(*) AS df FROM slot_tf GROUP BY ALL) f
  JOIN corpus_stats c USING (kb_id)),
chunk_vec AS MATERIALIZED (
  SELECT chunk_id, slot, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS FLOAT)
         AS DOUBLE) AS w
  FROM (SELECT chunk_id, slot, n * idf AS w FROM slot_tf JOIN slot_idf USING (kb_id, slot))),
question_tf AS (
  SELECT query_id, kb_id, {_SLOT} AS slot, count(*) AS n
  FROM (SELECT query_id, kb_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term
        FROM questions) GROUP BY ALL),
question_vec AS MATERIALIZED (
  SELECT query_id, slot, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS FLOAT)
         AS DOUBLE) AS w
  FROM (SELECT q.query_id, q.slot, q.n * coalesce(i.idf, ln(c.n_chunks + 1.0) + 1.0) AS w
        FROM question_tf q JOIN corpus_stats c USING (kb_id)
        LEFT JOIN slot_idf i USING (kb_id, slot)))"""


def vector_hits(k: int) -> str:
    """CTE vector_hits by cosine from chunk_vec and question_vec."""
    return f"""vector_hits AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM (
      SELECT q.query_id, c.chunk_id, round(sum(q.w * c.w) / (any_value(qn.s) * any_value(cn.s)), 6)
        AS score
      FROM question_vec q JOIN chunk_vec c USING (slot)
      JOIN (SELECT query_id, sqrt(sum(w * w)) AS s FROM question_vec GROUP BY 1) qn USING (query_id)
      JOIN (SELECT chunk_id, sqrt(sum(w * w)) AS s FROM chunk_vec GROUP BY 1) cn USING (chunk_id)
      GROUP BY q.query_id, c.chunk_id))
  WHERE rank <= {k})"""


def hybrid(top_k: int, vector_weight: float, keyword_weight: float) -> str:
    """CTE hits from vector_hits and keyword_hits."""
    return f"""sided AS (
  SELECT h.*, c.content, c.source, c.source || '_' || substring(c.content, 1, 50) AS key
  FROM (SELECT *, 'v' AS side FROM vector_hits UNION ALL BY NAME
        SELECT *, 'k' AS side FROM keyword_hits) h JOIN chunks c USING (chunk_id)),
by_vector AS (
  SELECT query_id, key, max_by(chunk_id, rank) AS chunk_id, min(rank) AS place,
         {vector_weight} / (60 + max(rank)) AS score
  FROM sided WHERE side = 'v' GROUP BY query_id, key),
by_keyword AS (
  SELECT query_id, key, min_by(chunk_id, rank) AS chunk_id, min(rank) AS place,
         sum(CAST({keyword_weight} AS DOUBLE) / (60 + rank)) AS score
  FROM sided WHERE side = 'k' GROUP BY query_id, key),
fused AS (
  SELECT query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.place AS vp, k.place AS kp,
         round(CAST(coalesce(v.score, 0.0) AS DOUBLE) + coalesce(k.score, 0.0), 9) AS rrf_score
  FROM by_vector v FULL OUTER JOIN by_keyword k USING (query_id, key)),
hits AS MATERIALIZED (
  SELECT f.query_id, f.rank, f.chunk_id, c.content, c.source, 0 AS page, 'text' AS type,
         '' AS image, f.rrf_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC,
                 vp ASC NULLS LAST, kp ASC NULLS LAST) AS rank FROM fused) f
  JOIN chunks c USING (chunk_id) WHERE f.rank <= {top_k})"""


CORPUS_LEXICON = f"{CHUNKS},\n{lexicon(chr(39) + 'corpus' + chr(39))}"
KB_LEXICON = f"{CHUNKS},\n{lexicon('kb_id')}"
USER_HITS = (
    f"{KB_LEXICON},\n{USER_QUESTIONS},\n{keyword_hits(5)},\n"
    "hits AS MATERIALIZED (SELECT h.*, c.content, c.source, 0 AS page, 'text' AS type, "
    "'' AS image FROM keyword_hits h JOIN chunks c USING (chunk_id))"
)


def with_(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then
