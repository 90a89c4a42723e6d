"""Answer-cache queries, batch and streaming, and the other streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import answer_cache as cache
from corpusloom.plans import bindings as b, sql
from corpusloom.session import materialize, new_path
from corpusloom.sources.files import write_texts
from corpusloom.streaming import ingest, questions

SMALL = 20
#: Text files of one folder, about, that a stream takes in: the driver keeps something of each.
FILES_PER_FOLDER = 25_000


def _filled(spark, sf):
    log = b.cache_log(spark, sf)
    return cache.insert(log.limit(0), log)


def cache_insert(spark, sf):
    return _filled(spark, sf).select("kb_id", "seq", "question", "answer", "created_at")


def cache_evict(spark, sf):
    return cache.evict(b.cache_log(spark, sf), SMALL).select("kb_id", "seq")


def cache_lookup(spark, sf):
    return cache.lookup(_filled(spark, sf), b.cache_questions(spark, sf)).select(
        "query_id", "kb_id", "hit", "similarity", "seq", "answer")


def _changed(spark, sf):
    return b.table(spark, sf, "embeddings").groupBy("label").agg(
        F.max("vec_id").alias("last")).filter("last % 3 = 0").select(
        F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb_id"))


def cache_invalidate(spark, sf):
    return cache.invalidate(_filled(spark, sf), _changed(spark, sf)).select("kb_id", "seq")


def cache_route(spark, sf):
    return cache.route(_filled(spark, sf), b.cache_questions(spark, sf)).select(
        "query_id", "kb_id", "branch", "similarity", "answer")


def cache_lookup_large(spark, sf):
    """Lookup in a cache of every answer, far more than an insert keeps, in several blocks."""
    log = b.cache_log(spark, sf).filter("answer <> ''")
    more = log.withColumn("seq", F.col("seq") + 10_000_000).withColumn(
        "embedding", F.transform("embedding", lambda x: -x))
    wide = log.withColumn("kb_id", F.lit("all")).unionByName(more.withColumn("kb_id", F.lit("all")))
    asked = b.cache_questions(spark, sf).withColumn("kb_id", F.lit("all"))
    return cache.lookup(wide, asked, rows_per_block=300).select(
        "query_id", "kb_id", "hit", "similarity", "seq", "answer")


def cache_fill(spark, sf):
    """The cache after every miss without history was answered and put back."""
    filled = _filled(spark, sf)
    routed = cache.route(filled, b.cache_questions(spark, sf))
    answered = routed.filter("branch <> 'hit'").select(
        "kb_id", (F.col("query_id") + 1_000_000).alias("seq"),
        F.concat(F.lit("asked "), F.col("query_id").cast("string")).alias("question"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.concat(F.lit("made "), F.col("query_id").cast("string")).alias("answer"),
        b.minutes_after_start(F.col("query_id")).alias("created_at"), "has_history")
    return cache.fill(filled, answered, SMALL).select("kb_id", "seq", "question", "answer")


def stream_ingest(spark, sf):
    """Chunks as the stream wrote them."""
    target = new_path(spark, "stream-chunks")
    ingest.start_ingest(ingest.document_stream(spark, sf), target,
                        new_path(spark, "state")).awaitTermination()
    return ingest.read_chunks(spark, target).select(
        "kb_id", F.col("doc_id").cast("long").alias("doc_id"), "chunk_id", "chunk_index",
        F.md5("content").alias("content_md5"))


def stream_registry(spark, sf):
    """Documents and cache after one stream wrote chunks and registry: counts and live answers."""
    log_path = new_path(spark, "registry-log")
    ingest.start_registry(ingest.document_stream(spark, sf), log_path, new_path(spark, "state"),
                          new_path(spark, "registry-chunks")).awaitTermination()
    log = ingest.read_log(spark, log_path)
    answers = b.table(spark, sf, "embeddings").select(
        F.concat(F.lit("src"), (F.col("vec_id") % 25).cast("string")).alias("kb_id"), "vec_id")
    live = cache.invalidate(answers, ingest.changed_kbs(log)).groupBy("kb_id").agg(
        F.count("*").alias("n_rows"), F.lit(None).cast("long").alias("n_chunks"))
    docs = ingest.current_documents(log).groupBy("kb_id").agg(
        F.count("*").alias("n_rows"), F.sum("chunk_count").alias("n_chunks"))
    return docs.withColumn("part", F.lit("documents")).unionByName(
        live.withColumn("part", F.lit("cache")))


def stream_text_files(spark, sf):
    """Chunks of the documents that a stream of text files brought, one file per document."""
    folder = new_path(spark, "text-files")
    docs = b.table(spark, sf, "documents")
    parts = -(-docs.count() // FILES_PER_FOLDER)
    write_texts(docs.filter("source is not null and text is not null"), folder, max(1, parts))
    target = new_path(spark, "text-chunks")
    ingest.ingest_folders(spark, folder, target, new_path(spark, "state"))
    return ingest.read_chunks(spark, target).select(
        F.regexp_extract("kb_id", "=(.*)", 1).alias("kb_id"), "chunk_index",
        F.md5("content").alias("content_md5"))


def stream_cache_lookup(spark, sf):
    """The question log as a stream against the stored cache."""
    asked = new_path(spark, "asked")
    b.cache_questions(spark, sf).write.parquet(asked)
    stream = spark.readStream.schema(
        "query_id long, kb_id string, embedding array<double>, has_history boolean").parquet(asked)
    target = new_path(spark, "stream-lookup")
    questions.start_lookup(stream, materialize(_filled(spark, sf), "cache"), target,
                           new_path(spark, "state")).awaitTermination()
    return spark.read.parquet(target).select(
        "query_id", "kb_id", "hit", "similarity", "seq", "answer")


def stream_live_cache(spark, sf):
    """Questions in two batches; between them the cache takes in what was missing of it."""
    whole = materialize(_filled(spark, sf), "cache")
    live = cache.CacheStore(spark, new_path(spark, "live-cache"), _schema(whole))
    asked, target, state = (new_path(spark, x) for x in ("asked", "stream-live", "state"))
    log = b.cache_questions(spark, sf)
    for turn in (0, 1):
        # Even answers first, then all.
        live.publish(whole.filter(F.lit(turn == 1) | (F.col("seq") % 2 == 0)))
        log.filter(F.col("query_id") % 2 == turn).write.mode("append").parquet(asked)
        stream = spark.readStream.schema(
            "query_id long, kb_id string, embedding array<double>, has_history boolean").parquet(asked)
        questions.start_lookup(stream, live, target, state).awaitTermination()
    return spark.read.parquet(target).select("query_id", "kb_id", "hit", "similarity", "seq", "answer")


def _schema(rows):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def stream_versions(spark, sf):
    """Documents in two batches, every third one changed in the second: the chunks that stay, and the
    answers left in a cache that each batch emptied for its kbs."""
    arrived, target, state = (new_path(spark, x) for x in ("arrived", "versions", "state"))
    docs = b.table(spark, sf, "documents")
    answers = b.table(spark, sf, "embeddings").select(
        F.concat(F.lit("src"), (F.col("vec_id") % 30).cast("string")).alias("kb_id"), F.col("vec_id").alias("seq"))
    live = cache.CacheStore(spark, new_path(spark, "live-cache"), "kb_id string, seq long")
    for turn in (1, 2):
        live.publish(answers)
        text = F.col("text") if turn == 1 else F.substring("text", 1, 700)
        docs.filter(F.lit(turn == 1) | (F.col("doc_id") % 3 == 0) & F.col("source").isin("src1", "src2")).select(
            *[text.alias(c) if c == "text" else c for c in docs.columns],
            b.minutes_after_start(F.lit(turn)).alias("modified")).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(ingest.DOCUMENT_SCHEMA + ", modified timestamp").parquet(arrived)
        ingest.start_versions(stream, target, state, cache=live).awaitTermination()
    kept = ingest.latest_chunks(spark, target).select(
        "kb_id", F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", F.md5("content").alias("content_md5"))
    left = live.current().groupBy("kb_id").agg(F.count("*").alias("n"))
    return kept.unionByName(left.select("kb_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(-1).alias("chunk_index"),
                                        F.col("n").cast("string").alias("content_md5")))


QUERIES = {f.__name__: f for f in (
    cache_insert, cache_evict, cache_lookup, cache_invalidate, cache_route,
    cache_lookup_large, cache_fill,
    stream_ingest, stream_registry, stream_text_files, stream_cache_lookup,
    stream_live_cache, stream_versions)}

_FILLED = f"""cache AS MATERIALIZED (
  SELECT * FROM (
    SELECT 'kb' || label AS kb_id, vec_id AS seq, 'question ' || vec_id AS question,
           CAST(embedding AS DOUBLE[]) AS v, 'answer ' || vec_id AS answer,
           {sql.START} + to_minutes(CAST(vec_id AS INTEGER)) AS created_at,
           row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS age
    FROM embeddings WHERE vec_id % 11 <> 0)
  WHERE age <= 200)"""

_BLANKED = """list_transform(CAST(embedding AS DOUBLE[]),
  LAMBDA x, i: CASE WHEN (i - 1) % 6 = 5 THEN 0.0 ELSE x END)"""

_FOUND = f"""asked AS (
  SELECT vec_id AS query_id,
         'kb' || (CASE WHEN vec_id % 4 = 3 THEN (label + 1) % 10 ELSE label END) AS kb_id,
         {_BLANKED} AS v, vec_id % 5 = 0 AS has_history
  FROM embeddings),
found AS (
  SELECT query_id, max_by(c.seq, (similarity, c.seq)) AS seq, max(similarity) AS similarity
  FROM (SELECT query_id, seq, raw, round(raw, 6) AS similarity FROM (
          SELECT a.query_id, c.seq, list_cosine_similarity(a.v, c.v) AS raw
          FROM asked a JOIN cache c USING (kb_id))) c
  WHERE raw >= 0.90 GROUP BY query_id),
looked AS (
  SELECT a.query_id, a.kb_id, f.seq IS NOT NULL AS hit, f.similarity, f.seq, c.answer,
         a.has_history
  FROM asked a LEFT JOIN found f USING (query_id)
  LEFT JOIN cache c ON c.kb_id = a.kb_id AND c.seq = f.seq)"""

_LOOKED = "SELECT query_id, kb_id, hit, similarity, seq, answer FROM looked"

_CHANGED_DOCS = f"""docs AS (
  SELECT doc_id, source AS kb_id, 'doc_' || doc_id || '.md' AS source, trim(t, {sql.BLANKS}) AS text
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 AND source IN ('src1', 'src2') THEN text[1:700] ELSE text END AS t
        FROM documents) WHERE length(trim(t, {sql.BLANKS})) > 0)"""

ORACLE = {
    "cache_insert": sql.with_(_FILLED, then="""
        SELECT kb_id, seq, question, answer, created_at FROM cache"""),
    "cache_evict": f"""
        SELECT kb_id, seq FROM (
          SELECT 'kb' || label AS kb_id, vec_id AS seq,
                 row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS age
          FROM embeddings) WHERE age <= {SMALL}""",
    "cache_lookup": sql.with_(_FILLED, _FOUND, then=_LOOKED),
    "cache_invalidate": sql.with_(_FILLED, then="""
        SELECT kb_id, seq FROM cache WHERE kb_id NOT IN (
          SELECT 'kb' || label FROM embeddings GROUP BY label HAVING max(vec_id) % 3 = 0)"""),
    "cache_route": sql.with_(_FILLED, _FOUND, then="""
        SELECT query_id, kb_id,
               CASE WHEN has_history THEN 'bypass' WHEN hit THEN 'hit' ELSE 'miss' END AS branch,
               CASE WHEN NOT has_history THEN similarity END AS similarity,
               CASE WHEN NOT has_history THEN answer END AS answer FROM looked"""),
    "cache_lookup_large": f"""
        WITH cache AS (
          SELECT vec_id AS seq, CAST(embedding AS DOUBLE[]) AS v, 'answer ' || vec_id AS answer
          FROM embeddings WHERE vec_id % 11 <> 0
          UNION ALL
          SELECT vec_id + 10000000, list_transform(CAST(embedding AS DOUBLE[]), LAMBDA x: -x),
                 'answer ' || vec_id FROM embeddings WHERE vec_id % 11 <> 0),
        asked AS (SELECT vec_id AS query_id, {_BLANKED} AS v FROM embeddings),
        found AS (
          SELECT query_id, max((round(s, 6), seq)) AS best
          FROM (SELECT query_id, seq, list_cosine_similarity(a.v, c.v) AS s FROM asked a, cache c)
          WHERE s >= 0.90 GROUP BY query_id)
        SELECT query_id, 'all' AS kb_id, best IS NOT NULL AS hit, best[1] AS similarity,
               best[2] AS seq, answer
        FROM asked LEFT JOIN found USING (query_id) LEFT JOIN cache c ON c.seq = best[2]""",
    "cache_fill": sql.with_(_FILLED, _FOUND, then=f"""
        SELECT kb_id, seq, question, answer FROM (
          SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY seq DESC) AS n FROM (
            SELECT kb_id, seq, question, answer FROM cache
            UNION ALL
            SELECT kb_id, query_id + 1000000, 'asked ' || query_id, 'made ' || query_id
            FROM looked WHERE NOT hit AND NOT has_history))
        WHERE n <= {SMALL}"""),
    "stream_ingest": sql.with_(sql.CHUNKS, then="""
        SELECT kb_id, doc_id, chunk_id, chunk_index, md5(content) AS content_md5 FROM chunks"""),
    "stream_text_files": sql.with_(sql.CHUNKS, then="""
        SELECT kb_id, chunk_index, md5(content) AS content_md5 FROM chunks"""),
    "stream_registry": sql.with_(sql.CHUNKS, then="""
        SELECT source AS kb_id, count(*) AS n_rows,
               CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_chunks, 'documents' AS part
        FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
          USING (doc_id) GROUP BY source
        UNION ALL
        SELECT 'src' || (vec_id % 25), count(*), NULL, 'cache' FROM embeddings
        WHERE 'src' || (vec_id % 25) NOT IN (SELECT kb_id FROM chunks) GROUP BY 1"""),
    "stream_live_cache": sql.with_(_FILLED, _FOUND.replace(
        "JOIN cache c USING (kb_id))", "JOIN cache c USING (kb_id) WHERE a.query_id % 2 = 1 OR c.seq % 2 = 0)"), then=_LOOKED),
    "stream_versions": sql.with_(_CHANGED_DOCS, sql.windows(), then="""
        SELECT kb_id, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(content) AS content_md5 FROM chunks
        UNION ALL
        SELECT 'src' || (vec_id % 30), -1, -1, CAST(count(*) AS VARCHAR) FROM embeddings
        WHERE 'src' || (vec_id % 30) NOT IN (SELECT source FROM documents
          WHERE doc_id % 3 = 0 AND source IN ('src1', 'src2')) GROUP BY 1"""),
    "stream_cache_lookup": sql.with_(_FILLED, _FOUND, then=_LOOKED),
}
