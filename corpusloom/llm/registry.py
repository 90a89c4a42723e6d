"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import ORACLE_SQL, run as pipeline
from corpusloom.llm.chat import as_replies, format_chats, read_back
from corpusloom.llm.common import table
from corpusloom.llm.dialogue_repair import damage, repair, repair_digests
from corpusloom.llm.exact_dedup import exact_duplicates
from corpusloom.llm.html_extract import extract_main_text
from corpusloom.llm.mixing import mix
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.positional_index import contamination
from corpusloom.llm.periodic_runs import periodic_runs, repeat_tails, run_digests
from corpusloom.llm.pivot_search import top_inner_products
from corpusloom.llm.quality import classify_quality
from corpusloom.llm.secrets import scan_secrets
from corpusloom.llm.token_files import read_token_files, write_token_files
from corpusloom.session import new_path


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents"))


def op10_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_main_text(table(spark, sf, "pages"))


_OP1 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return scan_secrets(table(spark, sf, "documents"), by_window=True)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_chats(as_replies(talks.union(extra))))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), path)
    return read_token_files(spark, path)


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=2)


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_inner_products(table(spark, sf, "embeddings"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


def op11_dialogue_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_digests(*repair(damage(table(spark, sf, "conversations")), dropped_col="dropped"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(periodic_runs(repeat_tails(table(spark, sf, "documents"))))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE)
    / 281474976710656.0::DOUBLE) / greatest(0.05::DOUBLE, 1 - 3 * ((length(t) - length(translate(t, '#$%&*|!', '')))
    / greatest(length(t), 1)::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
c AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS wanted FROM s),
l AS (SELECT *, cap / weight AS ratio, (wanted - coalesce(sum(cap) OVER b, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM c
  WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (ratio, rank)) FROM l
    WHERE ratio > level) * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size,
    floor(target)::BIGINT - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY k.source
      ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
  END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (gram)
  WHERE a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s
  UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT s.doc_id, len(any_value(s.grams)) AS n_shingles, min(other) AS component_id,
  s.doc_id = min(other) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""


_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS f FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.f, c.f)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


_OP11 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
x AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT),
    lambda x, b: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END), xor(x, b)),
    4294967295::BIGINT), 4294967295) % 20 AS kind FROM c),
y AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE kind <> 0),
z AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS i FROM y),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM z),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS rows FROM f GROUP BY conv_id),
ins(q, to_q, added) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'),
    (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
act(q, to_q, initial, edit, price) AS (VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0),
    (3, 2, 'u', 'K', 0), (0, 2, NULL, 'R', 3), (1, 2, NULL, 'R', 3), (2, 3, NULL, 'R', 3), (3, 2, NULL, 'R', 3),
    (0, 0, NULL, 'D', 4), (1, 1, NULL, 'D', 4), (2, 2, NULL, 'D', 4), (3, 3, NULL, 'D', 4)),
m AS (SELECT ins.q, act.to_q, initial, edit, 3 * length(added) + price AS price, added || edit AS added
  FROM ins JOIN act ON act.q = ins.to_q),
b AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': ''} AS way FROM conversations
  UNION ALL
  SELECT b.conv_id, b.i + 1, m.to_q, min({'cost': way.cost + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END,
      'audit': way.audit || added})
  FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
  JOIN m ON m.q = b.q AND (m.initial IS NULL OR m.initial = f.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, b.i + 1, m.to_q),
w AS (SELECT b.conv_id, min({'cost': way.cost + 3 * length(added), 'audit': way.audit || added}) AS way
  FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins ON ins.q = b.q AND ins.to_q IN (0, 3)
  WHERE b.i = coalesce(n.rows, 0) GROUP BY b.conv_id),
e AS (SELECT conv_id, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i, length(replace(audit[1:j], 'D', '')) AS t
  FROM (SELECT conv_id, way.audit AS audit, unnest(range(1, length(way.audit) + 1)) AS j FROM w)),
k AS (SELECT e.conv_id, edit, t, role, text, initial,
    bool_or(t = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id) AS headed
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (t - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY t) AS lines FROM k GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256
FROM w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS s,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT),
    lambda x, b: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END), xor(x, b)),
    4294967295::BIGINT), 4294967295) AS h FROM d),
a AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n ELSE n END AS a, h // 10 % 8 AS e FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM a),
t AS (SELECT r, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS t
  FROM (SELECT r, w, a, p, unnest(range(0, n)) AS i FROM p)),
l AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.t = y.t AND y.i > x.i JOIN c ON c.r = x.r
  WHERE 4 * (y.i - x.i) <= n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM l),
m AS (SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM g GROUP BY r, q, g
  HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT r, start, length, min(period) AS period FROM m GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, arg_max(u, (length * 1000000000000 // period, -start, -period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
k AS (SELECT t.r, string_agg(t, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM u
  WHERE u.r = t.r AND t.i >= u.start + u.period AND t.i < u.start + u.length) GROUP BY t.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
  best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
g AS (SELECT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda j: array_to_string(w[j:j + least(10, len(w)) - 1], ' '))) AS gram FROM i WHERE len(w) > 0),
s AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
m AS (SELECT r, j, s.k, item_id FROM s JOIN g ON g.k = s.k AND g.gram = array_to_string(w[j:j + s.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS p FROM m) GROUP BY r),
a AS (SELECT item_id, gram, arg_min(t, (coalesce(n, 0), p)) AS rarest FROM (SELECT DISTINCT item_id, gram,
    unnest(string_split(gram, ' ')) AS t, unnest(range(1, k + 1)) AS p FROM g) LEFT JOIN f USING (t) GROUP BY item_id, gram),
o AS (SELECT r, w, t, p FROM (SELECT r, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d)
  WHERE t IN (SELECT rarest FROM a)),
v AS (SELECT r, count(DISTINCT item_id) AS n_near FROM o JOIN a ON rarest = t
  WHERE list_has_all(w[greatest(1, p - 12):p + 12], string_split(gram, ' ')) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r) LEFT JOIN v USING (r)
"""


QUERIES = {
    "pipeline": pipeline,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_token_files": op5_token_files,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_packing": op9_packing,
    "op10_main_text": op10_main_text,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontamination": op13_decontamination,
}
ORACLE = {
    "op1_exact_dedup": _OP1,
    "op3_mixing": _OP3,
    "op6_near_dedup": _OP6,
    "op8_exact_top_k": _OP8,
    "op11_dialogue_repair": _OP11,
    "op12_periodic_runs": _OP12,
    "op13_decontamination": _OP13,
}
if ORACLE_SQL:
    ORACLE["pipeline"] = ORACLE_SQL
