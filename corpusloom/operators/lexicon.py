"""Term and corpus statistics that follow the chunk store by deltas.

Every change of the store adds one batch: what it does to the number of chunks, to the number of
tokens and to each term's document frequency, with a minus where chunks go. Statistics of any
version are sums over the batches up to it, so they equal those of a rebuild, and a change costs
what it changes. Batches are folders written whole, so one that is written again after a failure
counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.keyword import weigh_terms, with_tokens
from corpusloom.session import materialize, read_or_empty

SCHEMA = "kb_id string, term string, df long, n_chunks long, n_tokens long, version long"


class Lexicon:
    """Statistics of the chunks of knowledge bases, below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def deltas(self, version: int | None = None) -> DataFrame:
        """All batches, or those up to a version. A kb's totals are rows without a term."""
        rows = read_or_empty(self.spark, self.path, SCHEMA)
        return rows if version is None else rows.filter(F.col("version") <= version)

    def version(self) -> int:
        """The number of the last batch, 0 before the first."""
        return self.deltas().agg(F.max("version")).first()[0] or 0

    def _write(self, deltas: DataFrame, version: int) -> int:
        deltas.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    @staticmethod
    def measure(chunks: DataFrame, sign: int = 1) -> DataFrame:
        """What adding (or, with -1, removing) some chunks changes."""
        # One pass: a row without a term stands for the chunk itself.
        words = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tokens"))
        rows = with_tokens(chunks).select("kb_id", F.explode(words).alias("term"), F.size("tokens").alias("n"))
        whole = F.col("term").isNull()
        return rows.groupBy("kb_id", "term").agg(
            F.sum(F.when(whole, 0).otherwise(sign)).alias("df"), F.sum(F.when(whole, sign).otherwise(0)).alias("n_chunks"),
            F.sum(F.when(whole, sign * F.col("n")).otherwise(0)).cast("long").alias("n_tokens"))

    def add(self, chunks: DataFrame) -> int:
        """Chunks that were appended to the store; returns the new version."""
        return self._write(self.measure(chunks), self.version() + 1)

    def remove(self, chunks: DataFrame) -> int:
        """Chunks that were taken out."""
        return self._write(self.measure(chunks, -1), self.version() + 1)

    def _held(self, kb_ids: DataFrame) -> DataFrame:
        """Minus all that the lexicon holds of some kbs."""
        asked = kb_ids.select("kb_id").distinct()
        return self.totals().join(asked, "kb_id", "left_semi").select(
            "kb_id", "term", *[(-F.col(c)).alias(c) for c in ("df", "n_chunks", "n_tokens")])

    def drop(self, kb_ids: DataFrame) -> int:
        """Kbs that were dropped: their sums are taken back, no chunk is read."""
        return self._write(self._held(kb_ids), self.version() + 1)

    def replace(self, chunks: DataFrame) -> int:
        """Kbs whose chunks are now these."""
        fresh = materialize(self.measure(chunks), "lexicon-delta")
        both = self._held(fresh.select("kb_id")).unionByName(fresh).groupBy("kb_id", "term").agg(
            *[F.sum(c).alias(c) for c in ("df", "n_chunks", "n_tokens")])
        return self._write(materialize(both, "lexicon-delta"), self.version() + 1)

    def totals(self, version: int | None = None) -> DataFrame:
        """Sums of all batches up to a version, without what has become nothing."""
        return self.deltas(version).groupBy("kb_id", "term").agg(
            *[F.sum(c).alias(c) for c in ("df", "n_chunks", "n_tokens")]).filter("df <> 0 or n_chunks <> 0")

    def statistics(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(term statistics, corpus statistics) as ``keyword`` makes them from the chunks."""
        held = materialize(self.totals(version), "lexicon")
        corpus = held.filter("term is null").select(
            "kb_id", "n_chunks", (F.col("n_tokens") / F.col("n_chunks")).alias("avg_len"))
        return weigh_terms(held.filter("term is not null").select("kb_id", "term", "df"), corpus), corpus

    def compact(self) -> int:
        """All batches as one, under a version of its own; earlier versions can no longer be read."""
        last = self.version()
        whole = materialize(self.totals(), "lexicon")
        files = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        self._write(whole.limit(0), last + 1)
        for row in self.deltas().select("version").distinct().collect():
            target = files.Path(f"{self.path}/version={row.version}")
            target.getFileSystem(conf).delete(target, True)
        return self._write(whole, last + 1)
