"""Knowledge bases and their documents as tables: old tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_blocks

# Document states, the default kb, the mark of bulk-imported documents.
PROCESSING, READY, EMPTY, ERROR = "processing", "ready", "empty", "error"
DEFAULT_KB = "agent"
DEFAULT_DESCRIPTION = "Agent 默认知识库"
LOOSE_SOURCE = "agent_"
BULK_PREFIX = "seed_"
ID_CHARS = 32


def short_id(*parts: Column) -> Column:
    """Deterministic id: the head of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, ID_CHARS)


def create_kbs(kbs: DataFrame, requests: DataFrame) -> DataFrame:
    """Append requested kbs (request_id, name, description, created_at) with generated ids.

    An id hashes the request's own id too, so equal names at equal times stay apart; a request
    handed in twice is one kb.
    """
    fresh = requests.dropDuplicates(["request_id"]).select(
        short_id(F.col("request_id").cast("string"), F.col("name"),
                 F.col("created_at").cast("string")).alias("kb_id"),
        "name", F.coalesce("description", F.lit("")).alias("description"), "created_at")
    return kbs.unionByName(fresh)


def list_kbs(kbs: DataFrame) -> DataFrame:
    """All kbs, newest first; the id settles ties."""
    return kbs.orderBy(F.desc("created_at"), "kb_id")


def get_kb(kbs: DataFrame, kb_id: str) -> DataFrame:
    """The kb with this id, or no row."""
    return kbs.filter(F.col("kb_id") == kb_id)


def delete_kbs(tables: dict[str, DataFrame], dropped: DataFrame) -> dict[str, DataFrame]:
    """Remove kbs from every table that carries a kb_id: registry, chunks, cache and all."""
    gone = dropped.select("kb_id").distinct()
    return {name: table.join(gone, "kb_id", "left_anti") for name, table in tables.items()}


def default_kb(kbs: DataFrame) -> DataFrame:
    """One row (kb_id, is_new): the head of ``list_kbs``, or the default kb when there is none."""
    newest = kbs.groupBy("created_at").agg(F.min("kb_id").alias("kb_id")).agg(
        F.max_by("kb_id", "created_at").alias("kb_id"))
    return newest.select(F.coalesce("kb_id", F.lit(DEFAULT_KB)).alias("kb_id"),
                         F.col("kb_id").isNull().alias("is_new"))


def with_default_kb(kbs: DataFrame, created_at: Column) -> DataFrame:
    """The kbs, with the default one created where there is none at all."""
    none = kbs.agg(F.count("*").alias("n")).filter("n = 0")
    fresh = none.select(F.lit(DEFAULT_KB).alias("kb_id"), F.lit(DEFAULT_KB).alias("name"),
                        F.lit(DEFAULT_DESCRIPTION).alias("description"), created_at.alias("created_at"))
    return kbs.select(*fresh.columns).unionByName(fresh)


def register_documents(registry: DataFrame, kbs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Append uploads (doc_id, kb_id, filename, file_size, created_at) as ``processing``.

    Uploads into unknown kbs are refused, as a foreign key would.
    """
    known = uploads.join(kbs.select("kb_id"), "kb_id", "left_semi")
    return registry.unionByName(known.select(
        "doc_id", "kb_id", "filename", F.coalesce("file_size", F.lit(0)).alias("file_size"),
        F.lit(0).cast("long").alias("chunk_count"), F.lit(PROCESSING).alias("status"),
        "created_at"))


def update_status(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Set status and chunk_count per doc_id; an omitted count resets to 0.

    ``updates``: doc_id, seq, status, chunk_count. Of several updates the last one holds.
    """
    last = updates.groupBy("doc_id").agg(F.max_by(
        F.struct("status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")), "seq")
        .alias("u"))
    joined = registry.join(last, "doc_id", "left")
    return joined.select(*[
        F.coalesce(F.col(f"u.{c}").cast(registry.schema[c].dataType), F.col(c)).alias(c)
        if c in ("status", "chunk_count") else F.col(c) for c in registry.columns])


def list_documents(registry: DataFrame, kb_id: str | None = None) -> DataFrame:
    """Documents of one kb, or of all kbs kb by kb, newest first."""
    if kb_id is not None:
        registry = registry.filter(F.col("kb_id") == kb_id)
        return registry.orderBy(F.desc("created_at"), "doc_id")
    return registry.orderBy("kb_id", F.desc("created_at"), "doc_id")


def kb_statistics(kbs: DataFrame, registry: DataFrame) -> DataFrame:
    """(kb_id, doc_count, chunk_count) over ready documents; 0 where there are none."""
    ready = registry.filter(F.col("status") == READY).groupBy("kb_id").agg(
        F.count("*").alias("doc_count"), F.sum("chunk_count").alias("chunk_count"))
    return kbs.select("kb_id").join(ready, "kb_id", "left").select(
        "kb_id", F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def collection_counts(kbs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kb_id, n_chunks); 0 for a kb without chunks."""
    counts = chunks.groupBy("kb_id").agg(F.count("*").alias("n_chunks"))
    return kbs.select("kb_id").join(counts, "kb_id", "left").withColumn(
        "n_chunks", F.coalesce("n_chunks", F.lit(0)))


def stored_form(chunks: DataFrame) -> DataFrame:
    """Chunks as the store keeps them: page 0, image "" and type text for unknown values."""
    return chunks.withColumns({
        "page": F.coalesce("page", F.lit(0)), "image": F.coalesce("image", F.lit("")),
        "type": F.coalesce("type", F.lit("text"))})


def drop_collections(chunks: DataFrame, dropped: DataFrame) -> DataFrame:
    """Chunks without those of the dropped kbs; unknown ids are ignored."""
    return chunks.join(dropped.select("kb_id"), "kb_id", "left_anti")


def bulk_import(registry: DataFrame, files: DataFrame, size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Import files once per kb: returns (new registry rows, new chunks).

    A kb holding a ready ``seed_`` document is skipped as a whole. ``files``: kb_id, doc_id,
    filename, text, file_size, created_at, error (null unless reading failed). Every file
    ends as ready, empty or error on its own.
    """
    done = registry.filter(
        F.col("filename").startswith(BULK_PREFIX) & (F.col("status") == READY)
    ).select("kb_id").distinct()
    fresh = files.join(done, "kb_id", "left_anti")
    blocks = fresh.filter(F.col("error").isNull()).select(
        "kb_id", "doc_id", "text", F.lit(None).cast("int").alias("page"),
        F.col("filename").alias("source"), F.lit("text").alias("type"),
        F.lit(None).cast("string").alias("image"))
    chunks = chunk_blocks(blocks, size, overlap)
    counts = chunks.groupBy("kb_id", "doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    rows = fresh.drop("text").join(counts, ["kb_id", "doc_id"], "left").select(
        "doc_id", "kb_id", F.concat(F.lit(BULK_PREFIX), F.col("filename")).alias("filename"),
        "file_size", n.alias("chunk_count"),
        F.when(F.col("error").isNotNull(), ERROR).when(n > 0, READY).otherwise(EMPTY)
        .alias("status"), "created_at")
    return rows, chunks


def loose_blocks(texts: DataFrame) -> DataFrame:
    """Blocks for loose texts (kb_id, text_id, text), all under one source name."""
    return texts.select(
        "kb_id", F.col("text_id").cast("string").alias("doc_id"), "text",
        F.lit(None).cast("int").alias("page"), F.lit(LOOSE_SOURCE).alias("source"),
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"))


def add_texts(texts: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of loose texts, ready to append."""
    return stored_form(chunk_blocks(loose_blocks(texts), size, overlap))
