"""Score every row of a large table against blocks of questions, keeping only top rows.

The questions travel to the data: a block of them is broadcast, each task scores its own
rows and keeps the best ``k`` per question as it goes. No (question, row) pair leaves a
task unless it is among that task's best, so nothing is shuffled but ``k`` rows per
question and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.operators.ranking import top_k_per_group
from corpusloom.session import materialize, new_path

SCORE_DIGITS = 6
BLOCK_BYTES = 64 << 20
_CELLS = 2_000_000


class BestRows:
    """The best ``k`` rows per question seen so far: score descending, then row id."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.floor = np.full(n_questions, -np.inf)
        self.held = pd.DataFrame({"q": [], "score": [], "row_id": []})
        self.fresh: list[pd.DataFrame] = []
        self.n_fresh = 0

    def offer(self, scores: np.ndarray, row_ids: np.ndarray, valid: np.ndarray | None) -> None:
        """Take a rows x questions score matrix."""
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        if valid is not None:
            scores[~valid] = -np.inf
        floor = self.floor
        if len(scores) > self.k:
            cut = len(scores) - self.k
            floor = np.maximum(floor, np.partition(scores, cut, axis=0)[cut])
        rows, qs = np.nonzero((scores >= floor) & (scores > -np.inf))
        if len(rows):
            self.fresh.append(pd.DataFrame(
                {"q": qs, "score": scores[rows, qs], "row_id": row_ids[rows]}))
            self.n_fresh += len(rows)
            if self.n_fresh > max(50_000, 2 * self.k * len(self.floor)):
                self.settle()

    def settle(self) -> pd.DataFrame:
        """Drop everything that can no longer be among the best."""
        if self.fresh:
            parts = [self.held, *self.fresh] if len(self.held) else self.fresh
            merged = pd.concat(parts, ignore_index=True).sort_values(
                ["q", "score", "row_id"], ascending=[True, False, True], kind="stable")
            merged["_n"] = merged.groupby("q").cumcount()
            self.held = merged[merged["_n"] < self.k].drop(columns="_n")
            full = self.held.groupby("q")["score"].agg(["size", "min"])
            full = full[full["size"] == self.k]
            self.floor[full.index.to_numpy(dtype=int)] = full["min"].to_numpy()
            self.fresh, self.n_fresh = [], 0
        return self.held


def row_slices(n_rows: int, n_questions: int) -> Iterator[slice]:
    """Row ranges whose score matrix stays small."""
    step = max(1, _CELLS // max(1, n_questions))
    for at in range(0, n_rows, step):
        yield slice(at, min(n_rows, at + step))


Scorer = Callable[[dict, str, pa.RecordBatch, np.ndarray], Iterator[tuple]]


def best_per_task(block: Broadcast, score: Scorer, k: int, out: pa.Schema):
    """Function for ``mapInArrow``: per-task best rows of every question in the block.

    ``block.value`` maps kb_id to a dict with ``ids`` (question ids) and whatever ``score``
    needs. ``score(entry, kb_id, batch, rows)`` yields (row slice, scores, valid).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = block.value
        best: dict[str, BestRows] = {}
        for batch in batches:
            kbs = batch.column("kb_id").dictionary_encode()
            codes = kbs.indices.to_numpy(zero_copy_only=False)
            row_ids = None
            for code, kb in enumerate(kbs.dictionary.to_pylist()):
                entry = entries.get(kb)
                if entry is None:
                    continue
                if row_ids is None:
                    row_ids = np.array(batch.column("row_id").to_pylist(), dtype=object)
                rows = np.nonzero(codes == code)[0]
                keep = best.setdefault(kb, BestRows(len(entry["ids"]), k))
                for part, scores, valid in score(entry, kb, batch, rows):
                    keep.offer(scores, row_ids[rows[part]], valid)
        for kb, keep in best.items():
            held = keep.settle()
            if len(held):
                ids = entries[kb]["ids"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[q] for q in held["q"].astype(int)], out.field(0).type),
                    pa.array(held["row_id"].tolist(), pa.string()),
                    pa.array(held["score"].to_numpy(), pa.float64()),
                ], schema=out)

    return run


def scan_top_k(rows: DataFrame, questions: DataFrame, row_bytes: Column, k: int,
               pack: Callable[[pa.Table], dict], score: Scorer,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, row_id, score, rank): exact top ``k`` of ``rows`` per question.

    The size of the question side is measured first and cut into blocks of ``block_bytes``. The
    rows are scanned once per block, one block in memory at a time, and each block's best
    rows go to the shared folder; all of that happens when this is called. A semi-join with the
    block's kbs, no larger than the block itself, keeps other kbs' partitions unread.
    """
    spark = rows.sparkSession
    id_type = questions.schema["query_id"].dataType
    schema = StructType([StructField("query_id", id_type), StructField("row_id", StringType()),
                         StructField("score", DoubleType())])
    arrow_schema = pa.schema([
        ("query_id", pa.string() if isinstance(id_type, StringType) else pa.int64()),
        ("row_id", pa.string()), ("score", pa.float64())])
    if not isinstance(id_type, StringType):
        questions = questions.withColumn("query_id", F.col("query_id").cast("long"))
        schema["query_id"].dataType = questions.schema["query_id"].dataType

    total = questions.agg(F.sum(row_bytes)).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))

    path = new_path(spark, "scan")
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    stored = materialize(questions.withColumn("_block", block_of), "questions", ["_block"])
    for i in range(n_blocks):
        part = stored.filter(F.col("_block") == i).drop("_block")
        block = spark.sparkContext.broadcast(pack(part.toArrow()))
        asked = rows.join(F.broadcast(part.select("kb_id").distinct()), "kb_id", "left_semi")
        best = asked.mapInArrow(best_per_task(block, score, k, arrow_schema), schema)
        best.write.mode("append").parquet(path)
        block.unpersist()
    found = spark.read.schema(schema).parquet(path)
    return top_k_per_group(found, ["query_id"], [F.desc("score"), F.col("row_id")], k)
