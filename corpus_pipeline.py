"""A training corpus from raw documents: good ones, without copies, mixed by source, packed.

Each stage reads what the one before it kept, as a stored table. All but the last return the
columns of documents. Stages decide row by row: a row is judged by its own text whether its id
is null, repeated or unique, and of rows that are copies of each other one stays, that of the
least id. Rows are named by their place in the stored table, so no copy of it is made; texts of
rows that surely stay are not shuffled to drop others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.llm.common import free_name, without_ids
from corpusloom.llm.exact_dedup import exact_duplicates
from corpusloom.llm.mixing import apply_mix, mix
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import keep_good
from corpusloom.session import materialize


#: Rows that go to Python at once: whole texts, so a few megabytes as a rule.
ROWS_AT_ONCE = 512


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session sends no more rows at once to Python than that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that no two rows share, and its name.

    Keys sort by id, null last, then by file and row; a table that is not stored is stored first.
    Files go by their place in the folder, so equal tables get equal keys wherever they lie.
    """
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = materialize(docs, "documents")
    place = docs.metadataColumn("_metadata")
    key, path, file = (free_name(docs, x) for x in ("_key", "_path", "_file"))
    # A row per file, which the driver lists anyway.
    files = docs.select(place["file_path"].alias(path)).distinct().withColumn(
        file, F.row_number().over(Window.orderBy(path)))
    told = docs.withColumn(path, place["file_path"]).withColumn(key, place["row_index"]).join(F.broadcast(files), path)
    return told.withColumn(key, F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(file).alias("file"),
        F.col(key).alias("row"))).select(*[F.col(f"`{c}`") for c in docs.columns], key), key


def without(docs: DataFrame, key: str, judged: DataFrame) -> DataFrame:
    """The keyed documents that a stage keeps, without their keys."""
    dropped = materialize(judged.filter("not kept").select(F.col(key).alias("id")), "dropped")
    return without_ids(docs, dropped, key).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    in_small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    in_small_batches(spark)
    docs, key = keyed(docs)
    return without(docs, key, exact_duplicates(docs, key))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words; documents
    without words are linked with nothing and stay."""
    in_small_batches(spark)
    docs, key = keyed(docs)
    return without(docs, key, near_duplicates(docs, key, width=5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: a row per copy that it takes."""
    in_small_batches(spark)
    docs, key = keyed(docs)
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.col(key).cast("string"))
    return apply_mix(docs, mix(docs, key, draw=drawn), key).drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    in_small_batches(spark)
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup),
          ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL has no tokenizer and no classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
