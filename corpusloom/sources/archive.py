"""Evaluation archive: JSON files per comparison run, named by its time.

``summary/run=eval_YYYYmmdd_HHMMSS`` holds one nested row per run, ``details/run=...`` one
row per configuration and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_METRICS = ("context_precision: double, context_recall: double, faithfulness: double, "
            "answer_relevancy: double")
SUMMARY_SCHEMA = (
    "timestamp string, kb_id string, test_size long, results array<struct<name: string, "
    f"config: struct<top_k: int>, metrics: struct<{_METRICS}>>>"
)
DETAIL_SCHEMA = "config string, query_id long, " + _METRICS.replace(":", "")


def run_name(moment: Column) -> Column:
    """Name of a run made at ``moment``."""
    return F.concat(F.lit("eval_"), F.date_format(moment, "yyyyMMdd_HHmmss"))


def save_runs(runs: DataFrame, details: DataFrame, path: str) -> None:
    """Write runs and their per-question rows; both carry ``run``. A run saved again is replaced."""
    details.select("run", "config", "query_id", *[m.split(":")[0].strip()
                                                  for m in _METRICS.split(",")]) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run").json(f"{path}/details")
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run") \
        .json(f"{path}/summary")


def _read(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    rows = (
        spark.read.schema(schema).option("multiLine", str(multi_line).lower())
        .option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    name = F.regexp_extract("_file", r"(eval_\d{8}_\d{6})", 1)
    return rows.withColumn("run", name).drop("_file").filter(F.col("run") != "")


def read_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All readable runs with their name in ``run``; broken files are skipped.

    ``multi_line`` reads pretty-printed files, one run each.
    """
    return _read(spark, f"{path}/summary", SUMMARY_SCHEMA, multi_line).filter(
        F.col("results").isNotNull() | F.col("timestamp").isNotNull())


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Per-question rows of all runs."""
    return _read(spark, f"{path}/details", DETAIL_SCHEMA, False)


def summarize_runs(runs: DataFrame) -> DataFrame:
    """(run, timestamp, kb_id, test_size, configs), newest first by name."""
    return runs.select(
        "run", F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("kb_id", F.lit("")).alias("kb_id"),
        F.coalesce("test_size", F.lit(0)).alias("test_size"),
        F.coalesce(F.transform("results", lambda r: r["name"]),
                   F.array().cast("array<string>")).alias("configs"),
    ).orderBy(F.desc("run"))


def load_run(spark: SparkSession, path: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Summary and details of one run by name; no rows when it is missing or broken."""
    return (read_runs(spark, path).filter(F.col("run") == run),
            read_details(spark, path).filter(F.col("run") == run))
