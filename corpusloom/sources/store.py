"""The chunk store: parquet partitioned by kb_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from corpusloom.operators.catalog import stored_form
from corpusloom.operators.keyword import with_tokens
from corpusloom.operators.lexicon import Lexicon
from corpusloom.session import materialize, read_or_empty

# kb_id is declared, not guessed from folder names: "007" stays a string.
STORE_SCHEMA = (
    "doc_id string, chunk_id string, chunk_label string, chunk_index int, content string, "
    "page int, source string, type string, image string, kb_id string"
)

_COLUMNS = [field.split(" ")[0] for field in STORE_SCHEMA.split(", ")]


def store_rows(chunks: DataFrame) -> DataFrame:
    """Chunks in the store's columns, balanced for writing by kb.

    One kb lands in few files; AQE splits a large kb over tasks and merges small ones.
    """
    rows = stored_form(chunks).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.select(*_COLUMNS).hint("rebalance", "kb_id")


class ChunkStore:
    """Append, scan, replace and drop the chunks of knowledge bases below one path.

    With a ``lexicon`` its statistics follow every change; chunks are then stored once with
    their tokens before both are written.
    """

    def __init__(self, spark: SparkSession, path: str, lexicon: Lexicon | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.lexicon = lexicon

    def append(self, chunks: DataFrame) -> DataFrame:
        """Add chunks; returns the kb ids whose cached answers are now stale."""
        if self.lexicon:
            chunks = materialize(with_tokens(chunks), "new-chunks")
            self.lexicon.add(chunks)
        return self._write(chunks, "append")

    def _write(self, chunks: DataFrame, mode: str) -> DataFrame:
        """Write and tell which kbs were written, as seen on the way: texts are chunked once."""
        seen = Observation()
        rows = store_rows(chunks).observe(seen, F.collect_set("kb_id").alias("kbs"))
        (rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("kb_id").parquet(self.path))
        return self._ids(seen.get["kbs"])

    def _ids(self, kb_ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in sorted(kb_ids)], "kb_id string")

    def scan(self, kb_ids: list[str] | None = None) -> DataFrame:
        """All chunks, or those of some kbs; other partitions are not opened."""
        rows = read_or_empty(self.spark, self.path, STORE_SCHEMA)
        return rows if kb_ids is None else rows.filter(F.col("kb_id").isin(*kb_ids))

    def replace(self, chunks: DataFrame) -> DataFrame:
        """Overwrite the kbs present in ``chunks``, leave others alone; returns the stale kb ids."""
        if self.lexicon:
            chunks = materialize(with_tokens(chunks), "new-chunks")
            self.lexicon.replace(chunks)
        return self._write(chunks, "overwrite")

    def create(self, kb_ids: list[str]) -> None:
        """Start collections over: whatever they held is gone, the next append fills them."""
        self.drop(kb_ids)

    def drop(self, kb_ids: list[str]) -> DataFrame:
        """Remove whole kb partitions; ids without one are ignored. Returns the stale kb ids.

        Spark lists the kbs' files in one job that opens none of them, and their folders go.
        """
        if self.lexicon and kb_ids:
            self.lexicon.drop(self._ids(kb_ids))
        rows = self.scan(kb_ids)
        if kb_ids and not self._is_new():
            folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
            found = [r[0] for r in rows.select(folder).distinct().collect()]
            files = self.spark._jvm.org.apache.hadoop.fs
            conf = self.spark._jsc.hadoopConfiguration()
            for name in found:
                target = files.Path(self.spark._jvm.java.net.URI(name))
                target.getFileSystem(conf).delete(target, True)
        return self._ids(kb_ids)

    def _is_new(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
