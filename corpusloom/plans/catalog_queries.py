"""Sources, catalog and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog, chunking
from corpusloom.operators.lexicon import Lexicon
from corpusloom.operators.path_policy import PathRules
from corpusloom.plans import bindings as b, sql
from corpusloom.session import new_path
from corpusloom.sources import files
from corpusloom.sources.store import ChunkStore


def corpus_scan(spark, sf):
    return b.blocks(spark, sf).select(
        "doc_id", "kb_id", "source", "page", "type", F.length("text").alias("n_chars"),
        F.md5("text").alias("text_md5"))


def type_dispatch(spark, sf):
    return files.parse(b.file_paths(spark, sf)).select(
        "path", "source", "page", "type", "image", F.md5("text").alias("text_md5"))


def upload_admission(spark, sf):
    return files.admitted(b.file_paths(spark, sf)).select("path", "length")


def store_append(spark, sf):
    """Write all chunks through the store and read them back."""
    store = ChunkStore(spark, new_path(spark, "store"))
    store.append(chunking.chunk_blocks(b.blocks(spark, sf)))
    return store.scan().select("kb_id", "doc_id", "chunk_id", "chunk_label", "page", "type",
                               "image", F.md5("content").alias("content_md5"))


def store_scan(spark, sf):
    store = ChunkStore(spark, new_path(spark, "store"))
    store.append(b.chunks(spark, sf))
    return store.scan().select("kb_id", "chunk_id", "source",
                               F.length("content").alias("n_chars"))


def lexicon_versions(spark, sf):
    """Statistics that followed the store: two appends, a kb replaced by half of it, a kb dropped."""
    lexicon = Lexicon(spark, new_path(spark, "lexicon"))
    store = ChunkStore(spark, new_path(spark, "store"), lexicon)
    chunks = b.chunks(spark, sf)
    odd = F.col("doc_id").cast("long") % 2 == 1
    store.append(chunks.filter(odd))
    store.append(chunks.filter(~odd))
    store.replace(chunks.filter((F.col("kb_id") == "src5") & odd))
    store.drop(["src3"])
    terms, _ = lexicon.statistics()
    return terms.select("kb_id", "term", "df", F.round("idf", 6).alias("idf"))


def collection_counts(spark, sf):
    """Chunk counts of all kbs, among them two that hold nothing."""
    known = b.kbs(spark, sf).select("kb_id")
    empty = known.agg(F.count("*").alias("n")).select(
        F.explode(F.array(F.lit("void1"), F.lit("void2"))).alias("kb_id"))
    return catalog.collection_counts(known.unionByName(empty), b.chunks(spark, sf))


def collection_replace(spark, sf):
    """Replace the collections of kbs named src1* by smaller chunks; others stay."""
    store = ChunkStore(spark, new_path(spark, "store"))
    store.append(b.chunks(spark, sf))
    again = b.blocks(spark, sf).filter(F.col("kb_id").startswith("src1"))
    store.replace(chunking.chunk_blocks(again, 300, 30))
    return store.scan().groupBy("kb_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


def collection_drop(spark, sf):
    """Drop every kb that holds a large document in error state, keep the rest."""
    dropped = b.registry(spark, sf).filter("status = 'error' AND file_size > 20000").select("kb_id")
    left = catalog.drop_collections(b.chunks(spark, sf), dropped.distinct())
    return left.groupBy("kb_id").agg(F.count("*").alias("n_chunks"))


def kb_create(spark, sf):
    """Two new kbs per document language, of equal name and time, next to the existing ones."""
    wanted = b.table(spark, sf, "documents").groupBy("lang").agg(F.min("doc_id").alias("m")).select(
        F.explode(F.array(*[F.concat(F.col("lang"), F.lit(f"-{i}")) for i in (1, 2)]))
        .alias("request_id"),
        F.col("lang").alias("name"), F.lit(None).cast("string").alias("description"),
        b.minutes_after_start(F.col("m")).alias("created_at"))
    return catalog.create_kbs(b.kbs(spark, sf), wanted)


def kb_list(spark, sf):
    return catalog.list_kbs(b.kbs(spark, sf))


def kb_lookup(spark, sf):
    return catalog.get_kb(b.kbs(spark, sf), "src7")


def kb_delete_cascade(spark, sf):
    """What is left of registry and chunks after deleting the kbs with large documents."""
    gone = b.registry(spark, sf).filter("file_size > 20000").select("kb_id")
    left = catalog.delete_kbs({
        "kb": b.kbs(spark, sf).select("kb_id"),
        "document": b.registry(spark, sf).select("kb_id"),
        "chunk": b.chunks(spark, sf).select("kb_id")}, gone)
    parts = [rows.groupBy("kb_id").agg(F.count("*").alias("n_rows"))
             .withColumn("table_name", F.lit(name)) for name, rows in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _uploads(spark, sf):
    pages = b.table(spark, sf, "pages")
    return pages.select(
        (F.col("page_id") + 1_000_000_000).alias("doc_id"),
        F.concat(F.lit("src"), (F.col("page_id") % 23).cast("string")).alias("kb_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.length("html").cast("long").alias("file_size"),
        b.minutes_after_start(F.col("page_id")).alias("created_at"))


def document_register(spark, sf):
    return catalog.register_documents(b.registry(spark, sf), b.kbs(spark, sf),
                                      _uploads(spark, sf))


def document_status(spark, sf):
    """Two updates for each labelled document; the second omits its count when toxic."""
    labels = b.table(spark, sf, "labels")
    first = labels.select("doc_id", F.lit(1).alias("seq"), F.lit("processing").alias("status"),
                          F.lit(3).cast("long").alias("chunk_count"))
    second = labels.select(
        "doc_id", F.lit(2).alias("seq"),
        F.when(F.col("quality") == 1, "ready").otherwise("empty").alias("status"),
        F.when(F.col("toxic") == 0, F.lit(9)).cast("long").alias("chunk_count"))
    return catalog.update_status(b.registry(spark, sf), first.unionByName(second))


def document_list(spark, sf):
    return catalog.list_documents(b.registry(spark, sf)).select(
        "kb_id", "doc_id", "filename", "file_size", "chunk_count", "status", "created_at")


def kb_statistics(spark, sf):
    return catalog.kb_statistics(b.kbs(spark, sf), b.registry(spark, sf))


def bulk_import(spark, sf):
    """Import all documents into kbs by language, and every fifth into one more kb as well.

    English holds a ready import already.
    """
    docs = b.table(spark, sf, "documents")
    places = F.when(F.col("doc_id") % 5 == 0, F.array(F.col("lang"), F.lit("extra"))).otherwise(
        F.array("lang"))
    done = docs.filter("lang = 'en'").agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", F.lit("en").alias("kb_id"), F.lit("seed_first.md").alias("filename"),
        F.lit("ready").alias("status"))
    incoming = docs.select(
        F.explode(places).alias("kb_id"), "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("  \n ")).otherwise(F.col("text")).alias("text"),
        F.col("n_chars").alias("file_size"),
        b.minutes_after_start(F.col("doc_id")).alias("created_at"),
        F.when(F.col("doc_id") % 29 == 0, F.lit("unreadable")).alias("error"))
    rows, _ = catalog.bulk_import(done, incoming)
    return rows


def default_kb(spark, sf):
    """The newest kb where creation times are whole weeks, so that many are equal."""
    return catalog.default_kb(b.kbs(spark, sf).withColumn(
        "created_at", F.date_trunc("week", "created_at")))


def loose_texts(spark, sf):
    """Every conversation message as a loose text."""
    texts = b.table(spark, sf, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("kb_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("text_id"), "text")
    return catalog.add_texts(texts).select("kb_id", "chunk_id", "chunk_label", "page",
                                           F.md5("content").alias("content_md5"))


def guarded_load(spark, sf):
    """Load documents from paths of which the policy blocks some."""
    spots = F.array(*[F.lit(s) for s in ("/home/u", "file:/etc", "hdfs://nn:8020/home/u/secret", "s3x://b/home")])
    kinds = F.when(F.col("doc_id") % 12 == 0, ".pdf").otherwise(".md")
    paths = b.table(spark, sf, "documents").select(
        F.col("source").alias("kb_id"), "doc_id",
        F.concat(F.get(spots, (F.col("doc_id") % 4).cast("int")), F.lit("/doc_"),
                 F.col("doc_id").cast("string"), kinds).alias("path"),
        F.when(F.col("doc_id") % 40 == 0, F.lit(" ")).when(F.col("doc_id") % 24 == 0, F.lit(None))
        .otherwise(F.col("text")).alias("text"))
    chunks, rejected = files.guarded_load(paths, PathRules())
    loaded = chunks.groupBy("source").agg(F.count("*").alias("n_chunks")).select(
        F.concat(F.lit("/home/u/"), F.col("source")).alias("path"),
        F.lit("").alias("reason"), "n_chunks")
    return loaded.unionByName(rejected.withColumn("n_chunks", F.lit(0).cast("long")))


QUERIES = {f.__name__: f for f in (
    corpus_scan, type_dispatch, upload_admission, store_append, store_scan, lexicon_versions,
    collection_counts,
    collection_replace, collection_drop, kb_create, kb_list, kb_lookup, kb_delete_cascade,
    document_register, document_status, document_list, kb_statistics, bulk_import, default_kb,
    loose_texts, guarded_load)}

_PATHS = """paths AS (
  SELECT doc_id, source AS kb_id, n_chars * 1024 AS length, text,
         '/home/' || source || '/' || lang || '/doc_' || doc_id ||
         ['.md', '.TXT', '.csv', '.png', '.xyz', '.pdf', ''][doc_id % 7 + 1] AS path,
         lower(['.md', '.TXT', '.csv', '.png', '.xyz', '.pdf', ''][doc_id % 7 + 1]) AS suffix
  FROM documents)"""

_ID = ("substr(sha256(name || '-' || n || chr(31) || name || chr(31) || "
       "strftime(created_at, '%Y-%m-%d %H:%M:%S')), 1, 32)")

_LEFT_DOCS = sql.DOCS[:-1] + " AND source <> 'src3' AND (source <> 'src5' OR doc_id % 2 = 1))"

ORACLE = {
    "lexicon_versions": sql.with_(_LEFT_DOCS, sql.windows(), sql.lexicon("kb_id"), then="""
        SELECT kb_id, term, df, round(idf, 6) AS idf FROM terms"""),
    "corpus_scan": sql.with_(sql.DOCS, then="""
        SELECT doc_id, kb_id, source, CAST(NULL AS INTEGER) AS page, 'text' AS type,
               length(text) AS n_chars, md5(text) AS text_md5 FROM docs"""),
    "type_dispatch": sql.with_(_PATHS, then=f"""
        SELECT path, regexp_extract(path, '([^/]*)$', 1) AS source,
               CASE WHEN suffix IN ('.md', '.txt', '.csv', '.pdf') THEN NULL ELSE 1 END AS page,
               CASE WHEN suffix = '.png' THEN 'image' ELSE 'text' END AS type,
               CASE WHEN suffix = '.png' THEN path END AS image, md5(body) AS text_md5
        FROM (SELECT *, CASE WHEN suffix IN ('.md', '.txt', '.csv', '.pdf')
                             THEN trim(text, {sql.BLANKS})
                             WHEN suffix = '.png' THEN '[图片内容待 OCR / 本地视觉模型识别]'
                             ELSE '[暂不支持的文件类型 ' || suffix || ']' END AS body FROM paths)
        WHERE length(body) > 0"""),
    "upload_admission": sql.with_(_PATHS, then="""
        SELECT path, length FROM paths
        WHERE suffix IN ('.md', '.txt', '.csv', '.png', '.pdf') AND length <= 20971520"""),
    "store_append": sql.with_(sql.CHUNKS, then="""
        SELECT kb_id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_id,
               source || '_chunk' || chunk_index AS chunk_label, 0 AS page, 'text' AS type,
               '' AS image, md5(content) AS content_md5 FROM chunks"""),
    "store_scan": sql.with_(sql.CHUNKS, then="""
        SELECT kb_id, chunk_id, source, length(content) AS n_chars FROM chunks"""),
    "collection_counts": sql.with_(sql.CHUNKS, then="""
        SELECT kb_id, count(chunk_id) AS n_chunks
        FROM (SELECT DISTINCT source AS kb_id FROM documents
              UNION ALL VALUES ('void1'), ('void2')) LEFT JOIN chunks USING (kb_id)
        GROUP BY kb_id"""),
    "collection_replace": sql.with_(
        sql.CHUNKS, sql.windows(300, 30, "docs", "small"), then="""
        SELECT kb_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars
        FROM (SELECT kb_id, content FROM chunks WHERE kb_id NOT LIKE 'src1%'
              UNION ALL SELECT kb_id, content FROM small WHERE kb_id LIKE 'src1%')
        GROUP BY kb_id"""),
    "collection_drop": sql.with_(sql.CHUNKS, sql.REGISTRY, then="""
        SELECT kb_id, count(*) AS n_chunks FROM chunks
        WHERE kb_id NOT IN (SELECT kb_id FROM registry
                            WHERE status = 'error' AND file_size > 20000)
        GROUP BY kb_id"""),
    "kb_create": sql.with_(sql.KBS, then=f"""
        SELECT * FROM kbs UNION ALL
        SELECT {_ID} AS kb_id, name, '' AS description, created_at
        FROM (SELECT lang AS name,
                     {sql.START} + to_minutes(CAST(min(doc_id) AS INTEGER)) AS created_at
              FROM documents GROUP BY lang), range(1, 3) AS g(n)"""),
    "kb_list": sql.with_(sql.KBS, then="SELECT * FROM kbs ORDER BY created_at DESC, kb_id"),
    "kb_lookup": sql.with_(sql.KBS, then="SELECT * FROM kbs WHERE kb_id = 'src7'"),
    "kb_delete_cascade": sql.with_(sql.CHUNKS, sql.KBS, sql.REGISTRY, then="""
        SELECT kb_id, count(*) AS n_rows, table_name
        FROM (SELECT kb_id, 'kb' AS table_name FROM kbs
              UNION ALL SELECT kb_id, 'document' FROM registry
              UNION ALL SELECT kb_id, 'chunk' FROM chunks)
        WHERE kb_id NOT IN (SELECT kb_id FROM registry WHERE file_size > 20000)
        GROUP BY kb_id, table_name"""),
    "document_register": sql.with_(sql.REGISTRY, sql.KBS, then=f"""
        SELECT doc_id, kb_id, filename, file_size, chunk_count, status, created_at FROM registry
        UNION ALL
        SELECT page_id + 1000000000, 'src' || (page_id % 23), 'page_' || page_id || '.html',
               length(html), 0, 'processing',
               {sql.START} + to_minutes(CAST(page_id AS INTEGER))
        FROM pages WHERE 'src' || (page_id % 23) IN (SELECT kb_id FROM kbs)"""),
    "document_status": sql.with_(sql.REGISTRY, then="""
        SELECT r.doc_id, r.kb_id, r.filename, r.file_size,
               CASE WHEN l.doc_id IS NULL THEN r.chunk_count WHEN l.toxic = 0 THEN 9 ELSE 0 END
                 AS chunk_count,
               CASE WHEN l.doc_id IS NULL THEN r.status WHEN l.quality = 1 THEN 'ready'
                    ELSE 'empty' END AS status, r.created_at
        FROM registry r LEFT JOIN labels l USING (doc_id)"""),
    "document_list": sql.with_(sql.REGISTRY, then="""
        SELECT * FROM registry ORDER BY kb_id, created_at DESC, doc_id"""),
    "kb_statistics": sql.with_(sql.REGISTRY, sql.KBS, then="""
        SELECT kb_id, count(doc_id) AS doc_count,
               CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunk_count
        FROM kbs LEFT JOIN (SELECT * FROM registry WHERE status = 'ready') USING (kb_id)
        GROUP BY kb_id"""),
    "bulk_import": sql.with_(
        f"""docs AS (
          SELECT doc_id, lang AS kb_id, 'doc_' || doc_id || '.md' AS source, text
          FROM documents WHERE (lang <> 'en' OR doc_id % 5 = 0) AND doc_id % 17 <> 0
            AND doc_id % 29 <> 0
            AND length(trim(text, {sql.BLANKS})) > 0)""",
        sql.windows(), then=f"""
        SELECT d.doc_id, d.kb_id, 'seed_doc_' || d.doc_id || '.md' AS filename,
               d.n_chars AS file_size, coalesce(c.n, 0) AS chunk_count,
               CASE WHEN d.doc_id % 29 = 0 THEN 'error' WHEN c.n > 0 THEN 'ready'
                    ELSE 'empty' END AS status,
               {sql.START} + to_minutes(CAST(d.doc_id AS INTEGER)) AS created_at
        FROM (SELECT *, lang AS kb_id FROM documents WHERE lang <> 'en'
              UNION ALL SELECT *, 'extra' FROM documents WHERE doc_id % 5 = 0) d
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id)"""),
    "default_kb": sql.with_(sql.KBS, then="""
        SELECT kb_id, false AS is_new FROM kbs
        ORDER BY date_trunc('week', created_at) DESC, kb_id LIMIT 1"""),
    "loose_texts": sql.with_(
        f"""docs AS (
          SELECT conv_id || '-' || turn AS doc_id, 'src' || (conv_id % 20) AS kb_id,
                 'agent_' AS source, text
          FROM conversations WHERE length(trim(text, {sql.BLANKS})) > 0)""",
        sql.windows(), then="""
        SELECT kb_id, chunk_id, source || '_chunk' || chunk_index AS chunk_label, 0 AS page,
               md5(content) AS content_md5 FROM chunks"""),
    "guarded_load": sql.with_(
        f"""paths AS (
          SELECT doc_id, source AS kb_id,
                 ['/home/u', 'file:/etc', 'hdfs://nn:8020/home/u/secret', 's3x://b/home'][doc_id % 4 + 1]
                   || '/' || name AS path, name AS source,
                 trim(CASE WHEN doc_id % 40 = 0 THEN ' ' WHEN doc_id % 24 = 0 THEN '' ELSE text END,
                      {sql.BLANKS}) AS text
          FROM (SELECT *, 'doc_' || doc_id || CASE WHEN doc_id % 12 = 0 THEN '.pdf' ELSE '.md' END
                  AS name FROM documents))""",
        "docs AS (SELECT * FROM paths WHERE doc_id % 4 = 0 AND length(text) > 0)",
        sql.windows(), then="""
        SELECT '/home/u/' || source AS path, '' AS reason, count(*) AS n_chunks
        FROM chunks GROUP BY source
        UNION ALL
        SELECT path, CASE doc_id % 4
                 WHEN 1 THEN '安全拦截: 系统目录禁止访问: /etc'
                 WHEN 2 THEN '安全拦截: 敏感文件禁止访问: 包含 ''secret'''
                 WHEN 3 THEN '安全拦截: 路径不在允许范围内，仅允许访问用户目录和项目目录'
                 ELSE '文件 ''' || path || ''' 没有可解析的内容' END, 0
        FROM paths WHERE doc_id % 4 <> 0 OR length(text) = 0"""),
}
