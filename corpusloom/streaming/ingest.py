"""Continuous ingest: new rows of a document folder become chunks, exactly once."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import strip
from corpusloom.operators.answer_cache import CacheStore
from corpusloom.operators.catalog import EMPTY, READY
from corpusloom.operators.chunking import chunk_blocks, split_text
from corpusloom.session import materialize, read_or_empty
from corpusloom.sources.files import corpus_blocks
from corpusloom.sources.store import STORE_SCHEMA, store_rows

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str, pattern: str = "documents*.parquet",
                    files_per_batch: int = 1000) -> DataFrame:
    """New document files of a folder as a stream.

    What ``pattern`` names may be a file or a folder of part files, as Spark writes a table.
    """
    return (
        spark.readStream.schema(DOCUMENT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{pattern}")
    )


def text_file_stream(spark: SparkSession, folder: str, pattern: str = "*.{txt,md,csv}",
                     files_per_batch: int = 1000) -> DataFrame:
    """New text files below a folder as documents: doc_id from the path, source its folder.

    Bytes that are not UTF-8 are replaced. ``doc_id`` is a hash, so a file keeps its id; a changed
    file under the same name is not seen again, as everywhere in file streams: see
    ``ingest_changed_files``.
    """
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    )
    return _text_documents(files).drop("modificationTime")


def _text_documents(files: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.xxhash64("path").alias("doc_id"), text.alias("text"), F.lit("").alias("lang"),
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("source"),
        F.length(text).cast("long").alias("n_chars"), "modificationTime")


#: For batches of many small files: Spark lists them with a task for each path up to its default of
#: 10,000, reads 32 of them in a task, and keeps what it listed on the driver, up to 250 MB by its own count.
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
               "spark.sql.files.openCostInBytes": str(64 << 10),
               "spark.sql.hive.manageFilesourcePartitions": "false"}


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Settings for streams of many small files, as long as they run within; then those from before.

    A file source asks the session it was made in, so a stream that goes on needs them there for good.
    """
    before = {key: spark.conf.get(key, None) for key in SMALL_FILES}
    try:
        for key, value in SMALL_FILES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _start(documents: DataFrame, write, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _write_chunks(blocks: DataFrame, target: str, batch_id: int) -> None:
    # Within a batch, rows are balanced by kb: few files per small kb, several for a large one.
    (store_rows(chunk_blocks(blocks)).write.mode("overwrite").partitionBy("kb_id")
     .parquet(f"{target}/batch_id={batch_id}"))


def start_ingest(documents: DataFrame, target: str, checkpoint: str,
                 trigger: dict | None = None, cache: CacheStore | None = None) -> StreamingQuery:
    """Chunk a document stream into ``target``, each batch into its own folder.

    A batch that runs again after a failure overwrites its folder, so every document counts
    once. ``trigger`` is what ``DataStreamWriter.trigger`` takes; by default all there is now.
    Once a batch's chunks are written, the answers of its kbs leave the ``cache``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_chunks(corpus_blocks(batch), target, batch_id)
        if cache is not None:
            cache.invalidate(read_or_empty(
                batch.sparkSession, f"{target}/batch_id={batch_id}", STORE_SCHEMA).select("kb_id").distinct())

    return _start(documents, write, checkpoint, trigger)


def ingest_folders(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*.{txt,md,csv}",
                   files_per_batch: int = 100_000, at_once: int = 3, cache: CacheStore | None = None) -> None:
    """Take in the text files that are new in the folders of ``folder``, each as a stream of its own.

    A file stream lists all files below its folder each time and keeps the name of each for good, both on the
    driver. So its memory goes by the largest folders and not by all files: ``at_once`` streams
    run together, each until it has what there is now. Files that lie beside the folders are not taken.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    running: list[StreamingQuery] = []
    try:
        with small_files(spark):
            for name in names:
                if name.startswith(("_", ".")):
                    continue
                if len(running) == at_once:
                    running[0].awaitTermination()
                    running.pop(0)
                    # Frames of its batches, which name all files, may hang in cycles of Python objects.
                    gc.collect()
                # A name of its own for what a folder's stream writes, which is never taken for a number.
                feed = "f" + hashlib.md5(name.encode()).hexdigest()
                running.append(start_ingest(text_file_stream(spark, f"{folder}/{name}", pattern, files_per_batch),
                                            f"{target}/feed={feed}", f"{checkpoint}/{feed}", cache=cache))
            for query in running:
                query.awaitTermination()
    finally:
        for query in running:
            query.stop()


def read_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks a stream has written so far."""
    return read_or_empty(spark, target, STORE_SCHEMA + ", batch_id long")


VERSION_SCHEMA = "doc_id string, modified timestamp, n_chunks long, batch_id long"


def _write_versions(batch: DataFrame, target: str, batch_id: int, cache: CacheStore | None) -> None:
    newest = batch.groupBy("doc_id").agg(F.max("modified").alias("modified"))
    rows = materialize(batch.join(newest, ["doc_id", "modified"]).dropDuplicates(["doc_id"]), "arrivals")
    _write_chunks(corpus_blocks(rows), f"{target}/chunks", batch_id)
    written = read_or_empty(batch.sparkSession, f"{target}/chunks/batch_id={batch_id}", STORE_SCHEMA)
    counts = written.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows.select(F.col("doc_id").cast("string").alias("doc_id"), "modified").join(counts, "doc_id", "left").select(
        "doc_id", "modified", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks")).write.mode(
        "overwrite").parquet(f"{target}/versions/batch_id={batch_id}")
    if cache is not None:
        # Kbs that lose chunks are stale too: those of earlier versions of what arrived.
        told = read_chunks(batch.sparkSession, f"{target}/chunks").join(
            rows.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
        cache.invalidate(told.select("kb_id").distinct())


def start_versions(documents: DataFrame, target: str, checkpoint: str, trigger: dict | None = None,
                   cache: CacheStore | None = None) -> StreamingQuery:
    """Like ``start_ingest`` for documents that may arrive again, with a ``modified`` time.

    A batch writes the chunks of each document's latest arrival in it below ``target``/chunks, and
    a slim row per document below ``target``/versions. What an earlier version left is not
    touched; ``latest_chunks`` leaves it out. An arrival without chunks replaces too.
    """
    return _start(documents, lambda batch, batch_id: _write_versions(batch, target, batch_id, cache), checkpoint, trigger)


def latest_versions(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, modified, n_chunks, batch_id) of every document's latest arrival; of arrivals of
    one time the later batch's."""
    rows = read_or_empty(spark, f"{target}/versions", VERSION_SCHEMA)
    return rows.groupBy("doc_id").agg(F.max(F.struct("modified", "batch_id", "n_chunks")).alias("v")).select("doc_id", "v.*")


def latest_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of every document's latest version."""
    current = latest_versions(spark, target).select("doc_id", "batch_id")
    return read_chunks(spark, f"{target}/chunks").join(current, ["doc_id", "batch_id"], "left_semi")


def file_versions(spark: SparkSession, folder: str, target: str, pattern: str = "*.{txt,md,csv}") -> DataFrame:
    """Text files below a folder that are new or changed since ``target`` saw them.

    A file stream never looks at a path twice, so changed files are found by listing: times of
    files against those of their latest versions. Only files that go on are opened.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(folder))
    known = latest_versions(spark, target).select(F.col("doc_id").alias("known"), F.col("modified").alias("seen"))
    told = listed.select("path", "modificationTime").withColumn("doc_id", F.xxhash64("path"))
    wanted = told.join(known, F.col("doc_id").cast("string") == F.col("known"), "left").filter(
        F.col("seen").isNull() | (F.col("modificationTime") > F.col("seen"))).select("path").collect()
    if not wanted:
        return spark.createDataFrame([], DOCUMENT_SCHEMA + ", modified timestamp")
    files = spark.read.format("binaryFile").load([r.path for r in wanted])
    return _text_documents(files).withColumn("modified", F.col("modificationTime")).drop("modificationTime")


def ingest_changed_files(spark: SparkSession, folder: str, target: str, cache: CacheStore | None = None) -> int:
    """Take in what ``file_versions`` finds, as the next batch; returns the number of files."""
    rows = materialize(file_versions(spark, folder, target), "changed-files")
    last = read_or_empty(spark, f"{target}/versions", VERSION_SCHEMA).agg(F.max("batch_id")).first()[0]
    n = rows.count()
    if n:
        _write_versions(rows, target, 0 if last is None else last + 1, cache)
    return n


def start_registry(documents: DataFrame, log: str, checkpoint: str, chunks: str | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Write one registry update per arriving document to ``log``, and chunks if wanted.

    With ``chunks`` set, the batch's chunks are written there first and counted from what was
    written, so every text is chunked once. Each batch overwrites its own ``batch_id`` folder,
    so a batch that runs again after a failure leaves the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select(F.col("source").alias("kb_id"), "doc_id", "text")
        if chunks is None:
            counted = docs.withColumn("chunk_count", F.size(split_text(strip(F.col("text")))))
        else:
            _write_chunks(corpus_blocks(batch), chunks, batch_id)
            written = read_or_empty(batch.sparkSession, f"{chunks}/batch_id={batch_id}", STORE_SCHEMA)
            n = written.groupBy("kb_id", F.col("doc_id").cast(batch.schema["doc_id"].dataType).alias(
                "doc_id")).agg(F.count("*").alias("chunk_count"))
            counted = docs.join(n, ["kb_id", "doc_id"], "left")
        count = F.coalesce("chunk_count", F.lit(0)).cast("long")
        counted.select("kb_id", "doc_id", count.alias("chunk_count"), F.when(
            count > 0, READY).otherwise(EMPTY).alias("status")).write.mode("overwrite").parquet(
            f"{log}/batch_id={batch_id}")

    return _start(documents, write, checkpoint, trigger)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The registry log with its batch numbers."""
    return read_or_empty(
        spark, log, "kb_id string, doc_id long, chunk_count long, status string, batch_id long")


def current_documents(log: DataFrame) -> DataFrame:
    """Latest state of every document in the log."""
    return log.groupBy("doc_id").agg(F.max_by(
        F.struct("kb_id", "chunk_count", "status"), "batch_id").alias("d")
    ).select("doc_id", "d.*")


def changed_kbs(log: DataFrame, since_batch: int = -1) -> DataFrame:
    """kbs whose chunks changed after a batch: their cached answers are stale."""
    return log.filter((F.col("batch_id") > since_batch) & (F.col("chunk_count") > 0)) \
        .select("kb_id").distinct()
