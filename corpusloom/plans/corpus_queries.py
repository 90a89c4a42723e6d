"""Listing, previews, keyword search, path policy and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus_search, path_policy, traces
from corpusloom.plans import bindings as b, sql
from corpusloom.session import spread

KEYWORDS = ["the", "EN", "tion", "python", "é"]


def directory_listing(spark, sf):
    return corpus_search.list_directories(b.file_paths(spark, sf))


def directory_sizes(spark, sf):
    """Entry counts of every language folder a source could have."""
    entries = corpus_search.list_directories(b.file_paths(spark, sf))
    asked = b.kbs(spark, sf).select(F.explode(F.array(*[
        F.concat(F.lit("/home/"), F.col("kb_id"), F.lit(f"/{lang}")) for lang in ("en", "fr", "it")]))
        .alias("directory"))
    return corpus_search.directory_counts(entries, asked)


def directory_texts(spark, sf):
    """Listings of folders that hold files, that hold none, that are not there, and that are refused."""
    entries = corpus_search.list_directories(b.file_paths(spark, sf))
    kb = b.kbs(spark, sf).select("kb_id")
    asked = kb.select(F.explode(F.array(*[F.concat(F.lit("/home/"), F.col("kb_id"), F.lit(x)) for x in (
        "", "/en", "/void", "/.ssh/en")])).alias("directory")).unionByName(
        kb.select(F.concat(F.lit("/srv/"), F.col("kb_id")).alias("directory")))
    empty = kb.filter("kb_id > 'src2'").select(F.concat(F.lit("/home/"), F.col("kb_id"), F.lit("/void")).alias("directory"))
    out = corpus_search.listing_texts(entries, asked, known=empty)
    return out.select("directory", "state", F.md5("text").alias("text_md5"))


def line_preview(spark, sf):
    return corpus_search.preview(b.table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", F.md5("head").alias("head_md5"), F.md5("tail").alias("tail_md5"))


def _searchable(spark, sf):
    folders = F.array(*[F.lit(d) for d in (
        "docs", ".git", "src/venv", "my.github", "node_modules/x", "a/__pycache__", "lib")])
    ends = F.array(*[F.lit(e) for e in (".md", ".py", ".html", ".json", ".csv")])
    docs = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(
        F.concat(F.lit("/work/"), F.get(folders, (F.col("doc_id") % 7).cast("int")),
                 F.lit("/f"), F.col("doc_id").cast("string"),
                 F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("path"), "text")


def keyword_search(spark, sf):
    return corpus_search.search_keywords(_searchable(spark, sf), KEYWORDS)


def keyword_search_strict(spark, sf):
    """Skips directories by substring of their path."""
    return corpus_search.search_keywords(_searchable(spark, sf), KEYWORDS, strict=True)


def keyword_table_search(spark, sf):
    """All words of the benchmark passages as keywords, whole or as parts of words."""
    words = b.table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^\\p{L}]+")).alias("keyword"))
    return corpus_search.search_keywords(_searchable(spark, sf), words)


def path_policy_rules(spark, sf):
    """The rules as a table, with every tenth page's own path forbidden too."""
    paths = b.policy_paths(spark, sf)
    more = paths.filter("page_id % 10 = 0").select(
        F.lit("forbidden").alias("kind"), (1000 + F.col("page_id")).alias("ord"),
        path_policy.normalize(F.col("path")).alias("rule"))
    return path_policy.classify_by_rules(paths, path_policy.rule_rows(spark).unionByName(more))


def path_policy_read(spark, sf):
    return path_policy.classify(b.policy_paths(spark, sf))


def path_policy_write(spark, sf):
    return path_policy.classify(b.policy_paths(spark, sf), for_write=True)


def path_boundaries(spark, sf):
    """Which base folders hold each normalized path."""
    normal = b.policy_paths(spark, sf).withColumn("p", path_policy.normalize(F.col("path")))
    bases = ["/etc", "/home/u", "C:\\Windows", "C:\\Users"]
    return normal.select("page_id", *[
        path_policy.within(F.col("p"), base).alias(f"in_base{i}") for i, base in enumerate(bases)])


def sensitive_names(spark, sf):
    normal = b.policy_paths(spark, sf).withColumn("p", path_policy.normalize(F.col("path")))
    return normal.select("page_id", path_policy.sensitive_rule(F.col("p")).alias("rule"))


def run_summaries(spark, sf):
    out = traces.summarize_runs(b.agent_steps(spark, sf))
    return out.select("session", "steps", F.md5("answer").alias("answer_md5"))


def latency_summary(spark, sf):
    spans = b.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_type").alias("span"),
        F.col("value").alias("ms"))
    per_session = traces.latency_summary(spans, ["session", "span"])
    per_span = traces.latency_summary(spans, ["span"]).withColumn("session", F.lit(-1).cast("long"))
    return per_session.unionByName(per_span).withColumn("mean_ms", F.round("mean_ms", 6))


QUERIES = {f.__name__: f for f in (
    directory_listing, directory_sizes, directory_texts, line_preview, keyword_search, keyword_search_strict,
    keyword_table_search, path_policy_rules,
    path_policy_read, path_policy_write, path_boundaries, sensitive_names, run_summaries,
    latency_summary)}

_LISTING = """paths AS (
  SELECT string_split(ltrim('/home/' || source || '/' || lang || '/doc_' || doc_id ||
         ['.md', '.TXT', '.csv', '.png', '.xyz', '.pdf', ''][doc_id % 7 + 1], '/'), '/') AS p
  FROM documents),
entries AS (
  SELECT '/' || array_to_string(p[1:n - 1], '/') AS directory, p[n] AS name,
         CASE WHEN n = len(p) THEN 'file' ELSE 'folder' END AS kind, count(*) AS n_files
  FROM (SELECT p, unnest(generate_series(1, len(p))) AS n FROM paths) GROUP BY ALL)"""

_FILES = """files AS (
  SELECT '/work/' || ['docs', '.git', 'src/venv', 'my.github', 'node_modules/x', 'a/__pycache__',
         'lib'][doc_id % 7 + 1] || '/f' || doc_id ||
         ['.md', '.py', '.html', '.json', '.csv'][doc_id % 5 + 1] AS path, lower(text) AS t,
         doc_id FROM documents),
words(keyword) AS (VALUES ('the'), ('EN'), ('tion'), ('python'), ('é'))"""


def _search(skipped: str) -> str:
    return sql.with_(_FILES, then=f"""
        SELECT path, keyword, CAST((length(t) - length(replace(t, lower(keyword), '')))
                 / length(keyword) AS BIGINT) AS hits
        FROM files, words
        WHERE doc_id % 5 IN (0, 1, 3) AND doc_id % 7 NOT IN ({skipped})
          AND contains(t, lower(keyword))""")


_POLICY = """raw AS (
  SELECT page_id, ['/home/u', '/etc', '/home/u/../../proc', 'C:\\Windows\\..\\Users\\u',
           '/home/.ssh/..', '/home/u/.aws/credentials', 'C:\\WindowsApps', 'notes/./x', '/srv',
           '/home/u/secret.d', 'c:/windows/system32'][page_id % 11 + 1]
         || regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)
         || ['', '/.env', '/tokenization.py', '/token.txt', '/settings.json',
             '/Dockerfile'][(page_id // 11) % 6 + 1] AS path FROM pages),
rooted AS (
  SELECT page_id, path, CASE WHEN regexp_matches(s, '^[A-Za-z]:') OR s LIKE '/%' THEN s
           ELSE '/home/' || s END AS s
  FROM (SELECT *, replace(path, '\\', '/') AS s FROM raw)),
folded AS (
  SELECT page_id, path, regexp_matches(s, '^[A-Za-z]:') AS drive,
         list_reduce(list_transform(string_split(s, '/'), LAMBDA x: [x]), LAMBDA acc, x:
           CASE WHEN x[1] IN ('', '.') THEN acc
                WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1,
                  CASE WHEN regexp_matches(s, '^[A-Za-z]:') THEN 1 ELSE 0 END)]
                ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])) AS segs
  FROM rooted),
normal AS (
  SELECT page_id, path, CASE WHEN drive THEN '' ELSE '/' END || array_to_string(segs, '/')
           AS normalized FROM folded),
forbidden(rule, ord) AS (VALUES ('C:\\Windows', 1), ('C:\\Windows\\System32', 2),
  ('C:\\Windows\\SysWOW64', 3), ('/etc', 4), ('/sys', 5), ('/proc', 6), ('/boot', 7),
  ('C:\\Program Files', 8), ('C:\\Program Files (x86)', 9)),
sensitive(rule, ord) AS (VALUES ('.env', 1), ('.gitconfig', 2), ('id_rsa', 3), ('id_ed25519', 4),
  ('known_hosts', 5), ('authorized_keys', 6), ('credentials', 7), ('secret', 8),
  ('.aws/credentials', 9), ('.ssh/', 10), ('password', 11), ('token', 12)),
named AS (
  SELECT page_id, min_by(rule, ord) AS rule FROM normal, sensitive
  WHERE contains(lower(normalized) || '/', '/' || rtrim(rule, '/') || '/')
     OR (rule NOT LIKE '%/%' AND contains(lower(normalized), '/' || rule || '.')) GROUP BY 1),
barred AS (
  SELECT page_id, min_by(rule, ord) AS rule FROM normal, forbidden
  WHERE starts_with(lower(normalized) || '/', lower(replace(rule, '\\', '/')) || '/') GROUP BY 1),
judged AS (
  SELECT n.page_id, n.path, n.normalized, CASE
    WHEN b.rule IS NOT NULL THEN '系统目录禁止访问: ' || b.rule
    WHEN s.rule IS NOT NULL THEN '敏感文件禁止访问: 包含 ''' || s.rule || ''''
    WHEN NOT (starts_with(lower(normalized) || '/', 'c:/users/')
              OR starts_with(lower(normalized) || '/', '/home/'))
      THEN '路径不在允许范围内，仅允许访问用户目录和项目目录'
    ELSE '' END AS reason
  FROM normal n LEFT JOIN barred b USING (page_id) LEFT JOIN named s USING (page_id))"""

_QUANTILE = """SELECT {session} AS session, event_type AS span, count(*) AS n_spans,
       round(avg(value), 6) AS mean_ms,
       min(value) FILTER (rn >= ceil(0.5 * n)) AS p50_ms,
       min(value) FILTER (rn >= ceil(0.95 * n)) AS p95_ms
FROM (SELECT user_id, event_type, value,
             row_number() OVER (PARTITION BY {keys} ORDER BY value) AS rn,
             count(*) OVER (PARTITION BY {keys}) AS n FROM events)
GROUP BY {keys}"""

ORACLE = {
    "directory_listing": sql.with_(_LISTING, then="SELECT * FROM entries"),
    "directory_sizes": sql.with_(_LISTING, then="""
        SELECT directory, count(name) AS n_entries
        FROM (SELECT DISTINCT '/home/' || source || '/' || unnest(['en', 'fr', 'it']) AS directory
              FROM documents) LEFT JOIN entries USING (directory) GROUP BY directory"""),
    "directory_texts": sql.with_(_LISTING, """asked AS (
          SELECT kb, unnest(['', '/en', '/void', '/.ssh/en', '!']) AS tail FROM (SELECT DISTINCT source AS kb FROM documents)),
        told AS (SELECT CASE tail WHEN '!' THEN '/srv/' || kb ELSE '/home/' || kb || tail END AS directory, tail, kb FROM asked),
        lines AS (SELECT directory, count(*) AS n, string_agg(CASE kind WHEN 'folder' THEN '  [文件夹] ' ELSE '  [文件] ' END
          || name, chr(10) ORDER BY name, kind) AS body FROM entries GROUP BY directory),
        states AS (SELECT *, CASE WHEN tail IN ('/.ssh/en', '!') THEN 'blocked' WHEN n IS NOT NULL THEN 'listed'
          WHEN kb > 'src2' AND tail = '/void' THEN 'empty' ELSE 'missing' END AS state FROM told LEFT JOIN lines USING (directory))""", then="""
        SELECT directory, state, md5(CASE state
          WHEN 'blocked' THEN '安全拦截: ' || CASE tail WHEN '!' THEN '路径不在允许范围内，仅允许访问用户目录和项目目录'
            ELSE '敏感文件禁止访问: 包含 ''.ssh/''' END
          WHEN 'listed' THEN '目录 ''' || directory || ''' 包含 ' || n || ' 个文件/文件夹:' || chr(10) || body
          WHEN 'empty' THEN '目录 ''' || directory || ''' 是空的' ELSE '目录 ''' || directory || ''' 不存在' END) AS text_md5
        FROM states"""),
    "line_preview": """
        SELECT doc_id, len(p) AS n_lines,
               md5(CASE WHEN len(p) > 100 THEN array_to_string(p[1:30], chr(10)) ELSE text END)
                 AS head_md5,
               md5(CASE WHEN len(p) > 100 THEN array_to_string(p[len(p) - 29:], chr(10)) END)
                 AS tail_md5
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)""",
    "keyword_search": _search("1, 2, 4, 5"),
    "keyword_search_strict": _search("1, 2, 3, 4, 5"),
    "keyword_table_search": sql.with_(_FILES.split("words(keyword)")[0] + """words AS (
          SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS keyword FROM benchmark)""", then="""
        SELECT path, keyword, CAST(hits AS BIGINT) AS hits FROM (
          SELECT path, keyword, (length(t) - length(replace(t, lower(keyword), ''))) // length(keyword) AS hits
          FROM files, words WHERE keyword <> '' AND doc_id % 7 NOT IN (1, 2, 4, 5) AND doc_id % 5 NOT IN (2, 4)
            AND contains(t, lower(keyword))) WHERE hits > 0"""),
    "path_policy_rules": sql.with_(_POLICY, """more AS (SELECT 1000 + page_id AS ord, normalized AS rule FROM normal
          WHERE page_id % 10 = 0),
        hit AS (SELECT n.page_id, arg_min(rule, ord) AS rule FROM normal n JOIN more
          ON starts_with(lower(n.normalized) || '/', rtrim(lower(rule), '/') || '/') GROUP BY n.page_id)""", then="""
        SELECT page_id, path, normalized, told = '' AS allowed, told AS reason FROM (
          SELECT page_id, path, normalized, CASE WHEN starts_with(reason, '系统目录') OR rule IS NULL THEN reason
            ELSE '系统目录禁止访问: ' || rule END AS told FROM judged LEFT JOIN hit USING (page_id))"""),
    "path_policy_read": sql.with_(_POLICY, then="""
        SELECT page_id, path, normalized, reason = '' AS allowed, reason FROM judged"""),
    "path_policy_write": sql.with_(_POLICY, then="""
        SELECT page_id, path, normalized, reason = '' AS allowed, reason FROM (
          SELECT page_id, path, normalized, CASE WHEN reason = '' AND
                   string_split(normalized, '/')[-1] IN
                     ('settings.json', 'docker-compose.yml', 'Dockerfile', '.env')
                 THEN '禁止覆盖配置文件: ' || string_split(normalized, '/')[-1]
                 ELSE reason END AS reason FROM judged)"""),
    "path_boundaries": sql.with_(_POLICY, then="""
        SELECT page_id, starts_with(lower(normalized) || '/', '/etc/') AS in_base0,
               starts_with(lower(normalized) || '/', '/home/u/') AS in_base1,
               starts_with(lower(normalized) || '/', 'c:/windows/') AS in_base2,
               starts_with(lower(normalized) || '/', 'c:/users/') AS in_base3 FROM normal"""),
    "sensitive_names": sql.with_(_POLICY, then="""
        SELECT page_id, rule FROM normal LEFT JOIN named USING (page_id)"""),
    "run_summaries": """
        WITH calls AS (
          SELECT conv_id, turn, text, (conv_id + turn) % 3 = 0 AS tools,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
          FROM conversations WHERE role = 'assistant')
        SELECT conv_id AS session, coalesce(steps, 0) AS steps,
               md5(coalesce(nullif(answer, ''), '抱歉，Agent 没有生成回答。')) AS answer_md5
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (
          SELECT conv_id, count(*) AS steps, max_by(text, turn) FILTER (NOT tools) AS answer
          FROM calls WHERE n <= 8 GROUP BY conv_id) USING (conv_id)""",
    "latency_summary": _QUANTILE.format(session="user_id", keys="user_id, event_type")
    + " UNION ALL " + _QUANTILE.format(session="-1", keys="event_type"),
}
