"""Judging, metrics, configuration comparison and the evaluation archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import keyword, scoring, vectors
from corpusloom.plans import bindings as b, sql
from corpusloom.session import materialize, new_path
from corpusloom.sources import archive

CONFIGS = [("top_k=3", 3), ("top_k=5", 5), ("top_k=10", 10), ("top_k=20", 20)]


def judge_parse(spark, sf):
    return scoring.parse_judgements(b.judge_responses(spark, sf)).drop("raw")


def judge_prompts(spark, sf):
    """Prompts over user questions, with derived answers and references."""
    contexts = b.user_hits(spark, sf).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c")).select(
        "query_id", F.transform("c", lambda x: x["content"]).alias("contexts"))
    items = b.user_questions(spark, sf).join(contexts, "query_id").join(
        b.answers(spark, sf), "query_id").select(
        F.col("query_id").alias("question_id"), F.col("text").alias("question"),
        F.concat(F.lit("reference: "), F.col("text")).alias("reference"), "contexts", "answer")
    return scoring.judge_prompts(items).select("question_id", F.md5("prompt").alias("prompt_md5"))


def judge_means(spark, sf):
    """Per document source, and over everything."""
    parsed = scoring.parse_judgements(b.judge_responses(spark, sf))
    docs = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("question_id"), F.col("source").alias("kb_id"))
    by_kb = scoring.mean_judgements(parsed.join(docs, "question_id"), ["kb_id"])
    total = scoring.mean_judgements(parsed).withColumn("kb_id", F.lit("all"))
    return by_kb.unionByName(total)


def percent_scale(spark, sf):
    share = F.when(F.col("event_id") % 7 == 0, F.lit(None)) \
        .when(F.col("event_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value") / 97)
    return b.table(spark, sf, "events").select(
        "event_id", scoring.to_percent(share).alias("percent"))


def _ranked(spark, sf):
    """Vectors near each label's mean, with the verdict whether they carry the label."""
    rows = b.embeddings_as_rows(spark, sf)
    hits = vectors.dense_top_k(rows, b.label_centroids(spark, sf), 20, "vec_id")
    return hits.join(rows.select("vec_id", "label"), "vec_id").select(
        "query_id", "rank", (F.col("label") == F.col("query_id")).cast("int").alias("verdict"))


def _statements(spark, sf):
    return b.table(spark, sf, "labels").select(
        (F.col("doc_id") % 10).alias("query_id"), F.col("quality"), (1 - F.col("toxic")).alias("clean"))


def _relevancy(spark, sf):
    centre = b.label_centroids(spark, sf).select("query_id", F.col("embedding").alias("question_vector"))
    made = b.table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("generated_vector"))
    return scoring.answer_relevancy(made.join(centre, "query_id"), ["query_id"])


def context_precision(spark, sf):
    return scoring.context_precision(_ranked(spark, sf), ["query_id"]).select(
        "query_id", F.round("context_precision", 6).alias("context_precision"))


def context_recall(spark, sf):
    rows = _statements(spark, sf).withColumnRenamed("quality", "verdict")
    return scoring.share_supported(rows, ["query_id"], "context_recall").select(
        "query_id", F.round("context_recall", 6).alias("context_recall"))


def faithfulness(spark, sf):
    rows = _statements(spark, sf).withColumnRenamed("clean", "verdict")
    return scoring.share_supported(rows, ["query_id"], "faithfulness").select(
        "query_id", F.round("faithfulness", 6).alias("faithfulness"))


def answer_relevancy(spark, sf):
    return _relevancy(spark, sf).select(
        "query_id", F.round("answer_relevancy", 6).alias("answer_relevancy"))


def _per_config(spark, sf):
    """The four metrics per configuration and question; only precision depends on top_k."""
    cut = scoring.cut_per_config(materialize(_ranked(spark, sf), "ranked"), CONFIGS)
    precision = scoring.context_precision(cut, ["config", "top_k", "query_id"])
    said = _statements(spark, sf)
    rest = scoring.four_metrics([
        scoring.share_supported(said.withColumnRenamed("quality", "verdict"), ["query_id"],
                                "context_recall"),
        scoring.share_supported(said.withColumnRenamed("clean", "verdict"), ["query_id"],
                                "faithfulness"),
        _relevancy(spark, sf)], ["query_id"])
    return precision.join(rest, "query_id", "left")


def metric_means(spark, sf):
    """Means per configuration, lenient and strict about questions without a score."""
    scored = materialize(_per_config(spark, sf), "scored")
    group = ["config", "top_k"]
    lenient = scoring.mean_metrics(scored, group).withColumn("strict", F.lit(False))
    return lenient.unionByName(
        scoring.mean_metrics(scored, group, strict=True).withColumn("strict", F.lit(True)))


def config_comparison(spark, sf):
    means = scoring.mean_metrics(_per_config(spark, sf), ["config", "top_k"])
    table = scoring.side_by_side(means, [name for name, _ in CONFIGS])
    return table.toDF("metric", *[f"k{k}" for _, k in CONFIGS])


def word_overlap(spark, sf):
    """Share of a question's words found in each retrieved chunk."""
    pairs = b.user_hits(spark, sf).join(b.user_questions(spark, sf).select("query_id", "text"),
                                        "query_id")
    return scoring.word_overlap(pairs, "text", "content").select(
        "query_id", "rank", F.round("overlap", 6).alias("overlap"))


def demo_questions(spark, sf):
    """The built-in test set asked of the whole corpus."""
    terms, stats = b.corpus_lexicon(spark, sf)
    asked = scoring.demo_questions(spark).select(
        F.col("question_id").alias("query_id"), F.lit(b.CORPUS).alias("kb_id"),
        F.col("question").alias("text"))
    return b.postings(spark, sf).under(b.CORPUS).top_k(asked, terms, stats, 5)


def _archive(spark, sf):
    """Archive one run per question label, a day apart, and one over all labels."""
    scored = materialize(_per_config(spark, sf), "scored")
    day = F.timestamp_add("DAY", F.col("query_id").cast("int"), F.lit(b.START).cast("timestamp"))
    details = scored.withColumn("run", archive.run_name(day)).withColumn(
        "kb_id", F.concat(F.lit("kb"), F.col("query_id").cast("string"))).withColumn(
        "timestamp", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    moment = F.lit("2024-02-03 04:05:06").cast("timestamp")
    total = scored.withColumn("run", archive.run_name(moment)).withColumn(
        "kb_id", F.lit("labels")).withColumn(
        "timestamp", F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    rows = details.unionByName(total)
    path = new_path(spark, "archive")
    archive.save_runs(scoring.evaluation_runs(rows), scoring.percent_details(rows), path)
    return path


def archive_list(spark, sf):
    runs = archive.read_runs(spark, _archive(spark, sf))
    return archive.summarize_runs(runs).withColumn("configs", F.array_join("configs", ","))


def archive_load(spark, sf):
    """One run by name, its results flattened."""
    loaded, _ = archive.load_run(spark, _archive(spark, sf), "eval_20240203_040506")
    return loaded.select("run", "timestamp", "kb_id", "test_size",
                         F.explode("results").alias("r")).select(
        "run", "timestamp", "kb_id", "test_size", F.col("r.name").alias("config"),
        F.col("r.config.top_k").alias("top_k"), "r.metrics.*")


def archive_details(spark, sf):
    """Per-question scores of all archived runs, read back."""
    return archive.read_details(spark, _archive(spark, sf)).select(
        "run", "config", "query_id", *scoring.METRICS)


QUERIES = {f.__name__: f for f in (
    judge_parse, judge_prompts, judge_means, percent_scale, context_precision, context_recall,
    faithfulness, answer_relevancy, metric_means, config_comparison, word_overlap,
    demo_questions, archive_list, archive_load, archive_details)}

_RAW = """raws AS (
  SELECT doc_id, CASE
           WHEN doc_id % 12 = 0 THEN body || ' ' || body
           WHEN doc_id % 20 = 0 THEN body || '}'
           WHEN doc_id % 28 = 0 THEN body || ', ' || body
           WHEN doc_id % 4 = 0 THEN body
           WHEN doc_id % 4 = 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'end'
           WHEN doc_id % 4 = 2 THEN '```' || chr(10) || body || chr(10) || '```'
           ELSE 'no verdict for ' || doc_id || ' ' || repeat('x', CAST(doc_id % 300 AS INTEGER)) END AS raw
  FROM (SELECT doc_id, '{"context_recall": ' || (1 + quality * 4 - toxic) ||
               ', "context_precision": ' || (2 + quality * 3 - toxic) || ', "faithfulness": ' ||
               (5 - toxic * 2) || ', "answer_relevancy": ' || (doc_id % 5 + 1) ||
               ', "comment": "doc ' || doc_id || '"}' AS body FROM labels)),
fenced AS (
  SELECT doc_id, raw, CASE WHEN json_valid(raw) THEN raw
           WHEN strpos(raw, '```json') > 0 THEN regexp_extract(raw, '(?s)```json(.*?)```', 1)
           WHEN strpos(raw, '```') > 0 THEN regexp_extract(raw, '(?s)```(.*?)```', 1)
           ELSE raw END AS text FROM raws),
parsed AS (
  SELECT doc_id AS question_id, raw, json_valid(text) AS ok,
         CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM fenced),
judged AS (
  SELECT question_id, CAST(j->>'$.context_precision' AS DOUBLE) AS context_precision,
         CAST(j->>'$.context_recall' AS DOUBLE) AS context_recall,
         CAST(j->>'$.faithfulness' AS DOUBLE) AS faithfulness,
         CAST(j->>'$.answer_relevancy' AS DOUBLE) AS answer_relevancy,
         j->>'$.comment' AS comment, CASE WHEN NOT ok THEN 'JSON 解析失败' END AS error,
         CASE WHEN NOT ok THEN substring(raw, 1, 200) END AS raw_head
  FROM parsed)"""


def _means(group: str, rows: str) -> str:
    return f"""SELECT {group} AS kb_id, count(*) FILTER (error IS NULL) AS n_judged,
      coalesce(round_even(avg(context_precision), 2), 0.0) AS context_precision,
      coalesce(round_even(avg(context_recall), 2), 0.0) AS context_recall,
      coalesce(round_even(avg(faithfulness), 2), 0.0) AS faithfulness,
      coalesce(round_even(avg(answer_relevancy), 2), 0.0) AS answer_relevancy,
      CAST(NULL AS VARCHAR) AS error FROM {rows}"""


_RANKED = """vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
parts AS (
  SELECT label, avg(v[i]) AS m, i FROM vecs, generate_series(1, 64) AS g(i) GROUP BY label, i),
centroids AS (SELECT label, list(m ORDER BY i) AS v FROM parts GROUP BY label),
ranked AS MATERIALIZED (
  SELECT query_id, rank, CAST(query_id = label AS INTEGER) AS verdict FROM (
    SELECT c.label AS query_id, v.label,
           row_number() OVER (PARTITION BY c.label ORDER BY
             round(list_cosine_similarity(c.v, v.v), 6) DESC, CAST(v.vec_id AS VARCHAR)) AS rank
    FROM centroids c, vecs v) WHERE rank <= 20),
recall AS (SELECT doc_id % 10 AS query_id, avg(quality) AS context_recall,
                  avg(1 - toxic) AS faithfulness FROM labels GROUP BY 1),
relevancy AS (
  SELECT c.label AS query_id, avg(list_cosine_similarity(c.v, v.v)) AS answer_relevancy
  FROM centroids c JOIN vecs v USING (label) GROUP BY 1),
configs(config, top_k) AS (VALUES ('top_k=3', 3), ('top_k=5', 5), ('top_k=10', 10), ('top_k=20', 20)),
precisions AS (
  SELECT config, top_k, query_id, sum(p * verdict) / nullif(sum(verdict), 0) AS context_precision
  FROM (SELECT config, top_k, query_id, verdict,
               sum(verdict) OVER (PARTITION BY config, query_id ORDER BY rank) / rank AS p
        FROM ranked, configs WHERE rank <= top_k) GROUP BY ALL),
scored AS (
  SELECT p.*, context_recall, faithfulness, answer_relevancy
  FROM precisions p LEFT JOIN recall USING (query_id) LEFT JOIN relevancy USING (query_id))"""

_METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
_MEANS = "means AS (SELECT config, top_k, count(*) AS test_size, " + ", ".join(
    f"round_even(avg(coalesce({m}, 0.0)) * 100, 1) AS {m}" for m in _METRICS) + \
    " FROM scored GROUP BY config, top_k)"
_STRICT = "SELECT config, top_k, count(*) AS test_size, " + ", ".join(
    f"CASE WHEN count({m}) < count(*) THEN 0.0 ELSE round_even(avg({m}) * 100, 1) END AS {m}"
    for m in _METRICS) + ", true AS strict FROM scored GROUP BY config, top_k"

_RUNS = """runs AS (
  SELECT 'eval_' || strftime(TIMESTAMP '2024-01-01' + to_days(query_id), '%Y%m%d_%H%M%S') AS run,
         strftime(TIMESTAMP '2024-01-01' + to_days(query_id), '%Y-%m-%d %H:%M:%S') AS timestamp,
         'kb' || query_id AS kb_id, * FROM scored
  UNION ALL
  SELECT 'eval_20240203_040506', '2024-02-03 04:05:06', 'labels', * FROM scored)"""

_DEMO = """questions(query_id, kb_id, text) AS (VALUES
  (1, 'corpus', 'What is the use of splitting a text before it is indexed?'),
  (2, 'corpus', 'When does keyword search find what vectors miss?'),
  (3, 'corpus', 'How are two ranked lists merged without comparing scores?'),
  (4, 'corpus', 'Why is the answer cache emptied when documents change?'),
  (5, 'corpus', 'How does the reader know that a cited source is real?'))"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_JUDGE = " || ".join(f"{_quote(part)} || {value}" for part, value in zip(
    scoring.JUDGE_PROMPT, ("text", "'reference: ' || text", "contexts", "answer"))) + \
    f" || {_quote(scoring.JUDGE_PROMPT[-1])}"

ORACLE = {
    "judge_parse": sql.with_(_RAW, then="SELECT * FROM judged"),
    "judge_prompts": sql.with_(
        sql.USER_HITS,
        """contexts AS (SELECT query_id, string_agg(content, chr(10) || chr(10) || '---' ||
             chr(10) || chr(10) ORDER BY rank) AS contexts FROM hits GROUP BY query_id)""",
        """answers AS (
             SELECT conv_id * 100 + turn AS query_id, text || ' [' || (conv_id % 7 + 1) || '] ['
               || (turn % 4 + 1) || '], [' || (conv_id % 3) || '] [x] [99999999999]' AS answer
             FROM conversations WHERE role = 'user')""",
        then=f"""SELECT query_id AS question_id, md5({_JUDGE}) AS prompt_md5
                 FROM questions JOIN contexts USING (query_id) JOIN answers USING (query_id)"""),
    "judge_means": sql.with_(
        _RAW, then=_means("source", "judged JOIN documents ON doc_id = question_id GROUP BY source")
        + " UNION ALL " + _means("'all'", "judged")),
    "percent_scale": """
        SELECT event_id, CASE WHEN event_id % 7 < 2 THEN 0.0
                              ELSE round_even(value / 97 * 100, 1) END AS percent FROM events""",
    "context_precision": sql.with_(_RANKED, then="""
        SELECT query_id, round(context_precision, 6) AS context_precision FROM precisions
        WHERE top_k = 20"""),
    "context_recall": """
        SELECT doc_id % 10 AS query_id, round(avg(quality), 6) AS context_recall
        FROM labels GROUP BY 1""",
    "faithfulness": """
        SELECT doc_id % 10 AS query_id, round(avg(1 - toxic), 6) AS faithfulness
        FROM labels GROUP BY 1""",
    "answer_relevancy": sql.with_(_RANKED, then="""
        SELECT query_id, round(answer_relevancy, 6) AS answer_relevancy FROM relevancy"""),
    "metric_means": sql.with_(_RANKED, _MEANS, then=f"""
        SELECT config, top_k, test_size, {', '.join(_METRICS)}, false AS strict FROM means
        UNION ALL {_STRICT}"""),
    "config_comparison": sql.with_(_RANKED, _MEANS, then=" UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(
            f"max({m}) FILTER (top_k = {k}) AS k{k}" for _, k in CONFIGS) + " FROM means"
        for m in _METRICS)),
    "word_overlap": sql.with_(sql.USER_HITS, then=f"""
        SELECT query_id, rank, round(CASE WHEN len(a) = 0 THEN 0.0
                 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap
        FROM (SELECT query_id, rank,
                     list_distinct(regexp_extract_all(lower(q.text), {sql.WORDS})) AS a,
                     list_distinct(regexp_extract_all(lower(content), {sql.WORDS})) AS b
              FROM hits JOIN questions q USING (query_id))"""),
    "demo_questions": sql.with_(sql.CORPUS_LEXICON, _DEMO, sql.keyword_hits(5), then="""
        SELECT query_id, chunk_id, score, rank FROM keyword_hits"""),
    "archive_list": sql.with_(_RANKED, _RUNS, then="""
        SELECT run, any_value(timestamp) AS timestamp, any_value(kb_id) AS kb_id,
               count(DISTINCT query_id) AS test_size,
               string_agg(DISTINCT config, ',' ORDER BY config) AS configs
        FROM runs GROUP BY run"""),
    "archive_load": sql.with_(_RANKED, _MEANS, then=f"""
        SELECT 'eval_20240203_040506' AS run, '2024-02-03 04:05:06' AS timestamp,
               'labels' AS kb_id, test_size, config, top_k, {', '.join(_METRICS)} FROM means"""),
    "archive_details": sql.with_(_RANKED, _RUNS, then="SELECT run, config, query_id, " + ", ".join(
        f"coalesce(round_even({m} * 100, 1), 0.0) AS {m}" for m in _METRICS) + " FROM runs"),
}
