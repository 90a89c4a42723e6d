"""Listing, previewing and searching a corpus of files or file-like rows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.operators.path_policy import PathRules, classify
from corpusloom.operators.scan import BLOCK_BYTES
from corpusloom.session import materialize

# Preview limits, searchable suffixes, skipped directories.
PREVIEW_LIMIT = 100
PREVIEW_EDGE = 30
SEARCHABLE = (".py", ".txt", ".md", ".json", ".yaml", ".yml", ".toml", ".cfg")
SKIPPED = (".git", "venv", "__pycache__", "node_modules")
# Marks of a listing's lines.
FOLDER_LINE = "  [文件夹] "
FILE_LINE = "  [文件] "


def list_directories(files: DataFrame) -> DataFrame:
    """(directory, name, kind, n_files): entries of every directory in a table of ``path``.

    ``n_files`` counts the files at or below an entry. Each path yields one row per level,
    reduced per task before the shuffle.
    """
    parts = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    levels = files.select(parts.alias("p")).select(
        "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    entries = levels.select(
        F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/"))
        .alias("directory"),
        F.get(F.col("p"), F.col("n") - 1).alias("name"),
        F.when(F.col("n") == F.size("p"), "file").otherwise("folder").alias("kind"))
    return entries.groupBy("directory", "name", "kind").agg(F.count("*").alias("n_files"))


def directory_counts(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(directory, n_entries) for asked directories; 0 for missing or empty ones."""
    counts = entries.groupBy("directory").agg(F.count("*").alias("n_entries"))
    return asked.select("directory").join(counts, "directory", "left").withColumn(
        "n_entries", F.coalesce("n_entries", F.lit(0)))


def listing_texts(entries: DataFrame, asked: DataFrame, rules: PathRules | None = PathRules(),
                  known: DataFrame | None = None) -> DataFrame:
    """(directory, state, text) of every asked directory, as a tool would answer.

    The path policy comes first: a directory it refuses is "blocked" with the reason. One without
    entries is "empty" if the table ``known`` (directory) has it, else "missing", as a table of
    files alone cannot tell. Others are "listed": a line with the number of entries, then the
    entries by name, folders and files marked.
    """
    one = asked.select("directory").distinct()
    judged = classify(one.withColumn("path", F.col("directory")), rules) if rules else one.withColumn("reason", F.lit(""))
    lines = entries.groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("name", "kind"))).alias("entries"))
    there = (known if known is not None else one.limit(0)).select("directory").distinct().withColumn("known", F.lit(True))
    rows = judged.select("directory", "reason").join(lines, "directory", "left").join(there, "directory", "left")
    state = F.when(F.col("reason") != "", "blocked").when(F.col("entries").isNotNull(), "listed").when(
        F.col("known"), "empty").otherwise("missing")
    quoted = F.concat(F.lit("目录 '"), F.col("directory"), F.lit("' "))
    entry = F.transform("entries", lambda e: F.concat(
        F.when(e["kind"] == "folder", FOLDER_LINE).otherwise(FILE_LINE), e["name"]))
    listed = F.concat(quoted, F.lit("包含 "), F.size("entries").cast("string"), F.lit(" 个文件/文件夹:\n"),
                      F.array_join(entry, "\n"))
    text = F.when(F.col("state") == "blocked", F.concat(F.lit("安全拦截: "), F.col("reason"))).when(
        F.col("state") == "listed", listed).when(F.col("state") == "empty", F.concat(quoted, F.lit("是空的"))).otherwise(
        F.concat(quoted, F.lit("不存在")))
    return rows.withColumn("state", state).select("directory", "state", text.alias("text"))


def preview(texts: DataFrame, limit: int = PREVIEW_LIMIT, edge: int = PREVIEW_EDGE) -> DataFrame:
    """Add n_lines, head and tail; a text up to ``limit`` lines comes whole as head."""
    lines = F.col("_lines")
    n = F.size(lines)
    long = n > limit
    split = texts.withColumn("_lines", F.split("text", "\n"))
    return split.select(
        *[c for c in texts.columns if c != "text"], n.alias("n_lines"),
        F.when(long, F.array_join(F.slice(lines, 1, edge), "\n")).otherwise(F.col("text"))
        .alias("head"),
        F.when(long, F.array_join(F.slice(lines, F.greatest(n - edge + 1, F.lit(1)),
                                          F.lit(edge)), "\n")).alias("tail"))


def searchable(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, text in lower case) of the files that a search looks into.

    Directories are skipped by whole segment, with ``strict`` by any substring of the directory path.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    skip = F.lit(False)
    for name in SKIPPED:
        needle = name if strict else f"/{name}/"
        skip = skip | F.contains(F.concat(F.lit("/"), folder), F.lit(needle))
    fits = F.lit(False)
    for suffix in SEARCHABLE:
        fits = fits | F.col("path").endswith(suffix)
    return files.filter(fits & ~skip).select("path", F.lower("text").alias("text"))


def _count_words(sent: Broadcast, out: pa.Schema):
    """mapInArrow: texts to a row per keyword that stands in them.

    One automaton for all keywords, made once a task, reads every text once. An occurrence counts
    if it begins behind the last one counted of the same keyword.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, (i, len(word)))
        automaton.make_automaton()
        for batch in batches:
            rows, found, counts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                free: dict[int, int] = {}
                hits: dict[int, int] = {}
                for end, (i, size) in automaton.iter(text or ""):
                    if end - size + 1 >= free.get(i, 0):
                        free[i] = end + 1
                        hits[i] = hits.get(i, 0) + 1
                rows += [row] * len(hits)
                found += [words[i] for i in hits]
                counts += hits.values()
            yield pa.RecordBatch.from_arrays([
                batch.column("path").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()),
                pa.array(counts, pa.int64())], schema=out)

    return run


def search_keywords(files: DataFrame, keywords: list[str] | DataFrame, strict: bool = False,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, keyword, hits) for searchable files outside skipped directories.

    ``keywords`` is a list, or a table with a column ``keyword`` of any length. Case does not
    matter, and occurrences of one keyword do not overlap. Keywords go to the tasks in blocks of
    ``block_bytes`` after their size was measured; every text is read once a block, whatever the
    number of keywords in it. Empty and null keywords are found nowhere.
    """
    spark = files.sparkSession
    if isinstance(keywords, list):
        keywords = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    asked = materialize(keywords.select("keyword", F.lower("keyword").alias("word")).filter(
        F.length("word") > 0).distinct(), "keywords")
    total = asked.agg(F.sum(F.length("word") + 64)).first()[0]
    if not total:
        return spark.createDataFrame([], "path string, keyword string, hits long")
    n_blocks = -(-total // block_bytes)
    out = StructType([StructField("path", StringType()), StructField("word", StringType()),
                      StructField("hits", LongType())])
    texts = searchable(files, strict)
    found = None
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == block)
        sent = spark.sparkContext.broadcast([r[0] for r in part.select("word").distinct().collect()])
        rows = texts.mapInArrow(_count_words(sent, to_arrow_schema(out)), out)
        found = rows if found is None else found.unionByName(rows)
    # Back to the keywords as given; several may differ in case only.
    return found.join(asked, "word").select("path", "keyword", "hits")
