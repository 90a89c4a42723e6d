"""Session settings and the shared folder for tables that must outlive a task."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_removals: dict[str, int] = {}


def build_session(app_name: str = "corpusloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under.

    Nothing here fixes the size of the cluster: partition counts come from AQE and from
    the caller. Where executors do not have this package, call ``ship_package`` next.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    )
    if master:
        builder = builder.master(master)
        local = re.fullmatch(r"local\[(\d+)\]", master)
        if local:
            builder = builder.config(TEXT_PARTITIONS, str(2 * int(local[1])))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, made once per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "corpusloom", spark.sparkContext.applicationId,
                        f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Cuts lineage for tables that several later jobs read, such as the chunk store or term
    statistics. The copy is columnar, so later scans still prune columns and push filters
    down, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, without rows where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def input_state(spark: SparkSession, folder: str) -> tuple:
    """What stored tables made from the files in ``folder`` depend on: the application, how often
    its stored tables were removed, and the files' names, sizes and times."""
    app = spark.sparkContext.applicationId
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
    return app, _removals.get(app, 0), folder, tuple(files)


def remove_stored(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder, once it is done."""
    app = spark.sparkContext.applicationId
    _removals[app] = _removals.get(app, 0) + 1
    folder = os.path.join(shared_dir(spark), "corpusloom", spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Setting: partitions that texts are dealt into before row-wise Python work. Unset, the scan's
#: own splits are kept, so a cluster shuffles no texts.
TEXT_PARTITIONS = "spark.corpusloom.textPartitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by the TEXT_PARTITIONS setting, for inputs of a few large row groups."""
    wanted = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that do not have it installed."""
    import shutil

    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom")
    spark.sparkContext.addPyFile(shutil.make_archive(
        name, "zip", os.path.dirname(root), os.path.basename(root)))
