"""Concatenate and cut: all documents in one row of tokens, cut into windows of equal length.

First pass: every task tokenises its rows and stores the ids, with its own number and each
document's place among its tokens. The tasks' totals, summed up in order, give every task its
offset. Second pass: a document's global place is its task's offset plus its place there, so
each document is cut at the window borders by itself, without a sort or a shuffle of tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (BinaryType, IntegerType, LongType, StringType, StructField,
                               StructType)

from corpusloom.llm.common import small_slices
from corpusloom.llm.tokens import encoder, public_path
from corpusloom.session import materialize


def _tokenise(find: Callable[[], str], end_id: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(find())
        end = np.array([end_id], codec.dtype).tobytes()
        width = codec.dtype.itemsize
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in small_slices(batch):
                coded = [x + end for x in codec.encode(rows.column(1).to_pylist())]
                n = np.array([len(x) // width for x in coded], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts),
                    pa.array(n), pa.array(coded, pa.binary())], schema=out)

    return run


def _cut(find: Callable[[], str], window: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(find()).dtype
        for batch in batches:
            places = batch.column("place").to_numpy(zero_copy_only=False)
            row, start, length, crc, total, sequence, offset = [], [], [], [], [], [], []
            for i, coded in enumerate(batch.column("ids")):
                ids = np.frombuffer(coded.as_buffer(), dtype).astype("<u4")
                at, n, place = 0, len(ids), int(places[i])
                while at < n:
                    took = min(n - at, window - (place + at) % window)
                    row.append(i)
                    start.append(at)
                    length.append(took)
                    crc.append(zlib.crc32(ids[at:at + took]))
                    total.append(n)
                    sequence.append((place + at) // window)
                    offset.append((place + at) % window)
                    at += took
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, offset))],
                schema=out)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
         tokenizer: Callable[[], str] = public_path("byte_bpe_50k.json"), end_id: int = 1,
         window: int = 2048) -> DataFrame:
    """One row per piece of a document in a sequence of ``window`` tokens.

    A document is its token ids and ``end_id``; a null text is empty, so it is that id alone.
    Columns: id, start and length within the document, ids_crc32, doc_tokens, sequence_id, offset.
    All sequences are full but the last. Documents follow each other in the order their tasks
    read them. Repeated rows are documents of their own. Other columns are not looked at; an
    empty table has no pieces.
    """
    spark = docs.sparkSession
    field = StructField("id", docs.schema[id_col].dataType)
    stored = StructType([field, StructField("part", IntegerType()),
                         StructField("local", LongType()), StructField("n", LongType()),
                         StructField("ids", BinaryType())])
    pieces = StructType([field, *(StructField(x, LongType()) for x in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    arrow = {s: spark.createDataFrame([], t).toArrow().schema
             for s, t in (("stored", stored), ("pieces", pieces))}
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(
        F.col(text_col).cast(StringType()), F.lit("")).alias("text"))
    tokens = materialize(whole.mapInArrow(_tokenise(tokenizer, end_id, arrow["stored"]), stored),
                         "tokens")
    # One row per task of the first pass: the driver keeps more than that about each task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tokens.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        tokens.join(F.broadcast(offsets), "part")
        .select("id", (F.col("base") + F.col("local")).alias("place"), "ids")
        .mapInArrow(_cut(tokenizer, window, arrow["pieces"]), pieces)
        .withColumnRenamed("id", id_col))
