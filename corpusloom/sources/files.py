"""Text corpora from files or from a table of file contents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.text import has_text, strip
from corpusloom.operators.chunking import byte_slices, chunk_blocks
from corpusloom.operators.path_policy import PathRules, gate
from corpusloom.session import spread

# Suffixes by reader, upload limits, placeholder texts.
TEXT_SUFFIXES = (".txt", ".md", ".csv")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".webp")
CODEC_SUFFIXES = (".pdf", ".docx")
ALLOWED_SUFFIXES = CODEC_SUFFIXES + TEXT_SUFFIXES + IMAGE_SUFFIXES
MAX_FILE_BYTES = 20 * 1024 * 1024
IMAGE_PLACEHOLDER = "[图片内容待 OCR / 本地视觉模型识别]"
UNSUPPORTED_PREFIX = "[暂不支持的文件类型 "
BLOCKED = "安全拦截: "
HOLLOW = ("文件 '", "' 没有可解析的内容")


def suffix(path: str = "path"):
    """Lower-cased suffix of the file name, with its dot; empty when there is none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def file_name(path: str = "path"):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) below a folder. Contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, text): whole files, bytes that are not UTF-8 replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.make_valid_utf8(F.col("content").cast("string"))
                        .alias("text"))


def write_texts(texts: DataFrame, folder: str, parts: int = 1) -> None:
    """A file for each row of ``texts`` (source, text): ``folder``/part=../source=../..

    Files cost far more than their bytes, and who reads them as a stream keeps something of each: they are
    dealt out evenly to ``parts`` folders, and all cores make them. Hadoop starts a process for each file that
    it makes on a local disk, so there Python makes them; elsewhere Spark's writer does.
    """
    spark = texts.sparkSession
    n = 4 * spark.sparkContext.defaultParallelism
    rows = texts.select("source", "text", F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("part", F.pmod("id", F.lit(parts))).repartition(n, "id")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        # Tasks bring their own files to their place, so the driver does not rename each.
        (rows.drop("id").write.partitionBy("part", "source").option("maxRecordsPerFile", 1)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder))
        return
    place = path.toUri().getPath()
    os.makedirs(place)
    rows.mapInArrow(_local_files(place), "n long").agg(F.sum("n")).collect()


#: What Spark writes as %XX in the names of partition folders.
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _local_files(folder: str):
    """mapInArrow: (source, text, id, part) to how many files it made. Names go by id, so a task that runs again
    makes the same files, and none is seen before it is whole."""

    def named(source: str | None) -> str:
        return _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", source) if source else "__HIVE_DEFAULT_PARTITION__"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, str] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            done = 0
            for some in byte_slices(batch.column("text")):
                rows = batch.slice(done, len(some))
                done += len(some)
                for part, source, number, text in zip(*(
                        rows.column(c).to_pylist() for c in ("part", "source", "id", "text"))):
                    if (part, source) not in made:
                        made[part, source] = os.path.join(folder, f"part={part}", f"source={named(source)}")
                        os.makedirs(made[part, source], exist_ok=True)
                    at = os.path.join(made[part, source], f"part-{task:05d}-{number}.txt")
                    with open(f"{at}.tmp", "wb") as file:
                        file.write((text or "").encode() + b"\n")
                    os.replace(f"{at}.tmp", at)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return run


def admitted(files: DataFrame) -> DataFrame:
    """Files an upload would accept: known suffix and at most 20 MB."""
    return files.filter(suffix().isin(*ALLOWED_SUFFIXES) & (F.col("length") <= MAX_FILE_BYTES))


def parse(files: DataFrame) -> DataFrame:
    """One block per file (path, source, text, page, type, image) by suffix.

    Text files are stripped and skipped when empty. Images become a placeholder that keeps
    the image path. Unknown suffixes, and pdf and docx when no extracted text is given in a
    ``text`` column, never fail: unknown ones become a placeholder, the others pass through
    with the text they came with, one row per ``page`` if that column is there.
    """
    kind = suffix()
    is_text, is_image = kind.isin(*TEXT_SUFFIXES), kind.isin(*IMAGE_SUFFIXES)
    is_codec = kind.isin(*CODEC_SUFFIXES)
    body = (
        F.when(is_text | is_codec, strip(F.col("text")))
        .when(is_image, F.lit(IMAGE_PLACEHOLDER))
        .otherwise(F.concat(F.lit(UNSUPPORTED_PREFIX), kind, F.lit("]")))
    )
    extracted = F.col("page") if "page" in files.columns else F.lit(None)
    blocks = files.select(
        *[c for c in files.columns if c not in ("text", "length", "page")],
        file_name().alias("source"), body.alias("text"),
        F.when(is_codec, extracted).when(~is_text, F.lit(1)).cast("int").alias("page"),
        F.when(is_image, "image").otherwise("text").alias("type"),
        F.when(is_image, F.col("path")).alias("image"))
    return blocks.filter(has_text(F.col("text")))


def guarded_load(files: DataFrame, rules: PathRules = PathRules()) -> tuple[DataFrame, DataFrame]:
    """Chunks of the files the path policy allows, and (path, reason) of all others.

    ``files``: kb_id, doc_id, path, text, a row per file or per page. Every path ends up on one
    side: a file of any kind that no block came from is rejected with a reason rather than an
    error. Give it listed paths joined to their texts, so that refused files are never read.
    """
    allowed, refused = gate(files, rules)
    chunks = chunk_blocks(parse(allowed).select("kb_id", "doc_id", "text", "page", "source", "type",
                                                "image"))
    blocked = refused.select(
        "path", F.concat(F.lit(BLOCKED), F.col("reason")).alias("reason"))
    needs_text = suffix().isin(*TEXT_SUFFIXES, *CODEC_SUFFIXES)
    filled = F.coalesce(has_text(F.col("text")), F.lit(False))
    hollow = allowed.groupBy("path").agg(F.bool_or(~needs_text | filled).alias("any")).filter(
        "not any").select("path", F.concat(
            F.lit(HOLLOW[0]), F.col("path"), F.lit(HOLLOW[1])).alias("reason"))
    return chunks, blocked.unionByName(hollow)


def corpus_blocks(documents: DataFrame) -> DataFrame:
    """Blocks from a table of documents (doc_id, text, source), spread over the cluster."""
    narrow = spread(documents.select("doc_id", "text", "source"), "doc_id")
    text = strip(F.col("text"))
    return narrow.filter(has_text(F.col("text"))).select(
        F.col("source").alias("kb_id"), "doc_id", text.alias("text"),
        F.lit(None).cast("int").alias("page"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"))
