"""Token files: ids renamed by frequency, coded in whole bytes with separate control bytes.

A file set holds blocks in ascending document order. A block's ids are numbered by falling
frequency in the block, so most numbers fit one byte. Numbers take 1 to 4 bytes; their lengths,
two bits each, sit in control bytes of their own, four numbers to a byte. Reading looks the
control bytes up in a table of 256 times four lengths and gathers all numbers at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField,
                               StructType)

from corpusloom.llm.common import partitions_for, small_slices
from corpusloom.llm.tokens import encoder, public_path

#: A block is closed at this many tokens; one longer document makes a longer block.
BLOCK_TOKENS = 1 << 18
DOCS_PER_SHARD = 50_000
#: Below this, ids of a block are counted in a table of all ids.
COUNTED_IDS = 1 << 20

_LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.int64)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by falling frequency, control bytes, data bytes); equal counts by id."""
    if int(ids.max(initial=0)) < COUNTED_IDS:
        # Ids are small, so they are counted in place; sorting a block takes several times as long.
        every = np.bincount(ids)
        values = np.nonzero(every)[0]
        counts, index = every[values], ids
        rank_of = np.zeros(len(every), np.uint32)
    else:
        values, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
        rank_of = np.zeros(len(values), np.uint32)
    order = np.lexsort((values, -counts))
    rank_of[values[order] if index is ids else order] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[index]
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for byte in range(4):
        use = size > byte if byte else slice(None)
        data[at[use] + byte] = ranks[use] >> np.uint32(8 * byte) & np.uint32(0xFF)
    return (values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(),
            data.tobytes())


def decode_block(n: int, table: bytes, control: bytes, data: bytes) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + bytes(3), np.uint8)
    ranks = raw[at].astype(np.uint32)
    for byte in range(1, 4):
        use = np.nonzero(size > byte)[0]
        ranks[use] |= raw[at[use] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return np.frombuffer(table, "<u4")[ranks]


def _blocks(find: Callable[[], str], end_id: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(find())
        end = np.array([end_id], codec.dtype).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        ids, coded, held = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in coded]) // codec.dtype.itemsize
            parts = encode_block(np.frombuffer(b"".join(coded), codec.dtype))
            keys = pa.concat_arrays(ids)
            bounds = pa.array([0, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                pa.array([int(lengths.sum())], pa.int64()),
                *(pa.array([x], pa.binary()) for x in parts),
                pa.ListArray.from_arrays(bounds, keys),
                pa.ListArray.from_arrays(bounds, pa.array(lengths, pa.int64()))], schema=out)

        for batch in batches:
            for rows in small_slices(batch, size=256 << 10):
                fresh = [x + end for x in codec.encode(rows.column(1).to_pylist())]
                ids.append(rows.column(0))
                coded += fresh
                held += sum(map(len, fresh)) // codec.dtype.itemsize
                if held >= BLOCK_TOKENS:
                    yield close()
                    ids, coded, held, block = [], [], 0, block + 1
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      *, tokenizer: Callable[[], str] = public_path("word_bpe_49k.json"),
                      end_id: int = 1) -> None:
    """Write ids of all texts, each followed by ``end_id``, in ascending id order.

    Null texts are empty. Rows without an id come first; rows with equal ids follow each other
    in any order. Other columns are not looked at. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = StructType([
        StructField("shard", IntegerType()), StructField("block", IntegerType()),
        StructField("n_tokens", LongType()), StructField("ids_by_rank", BinaryType()),
        StructField("control", BinaryType()), StructField("data", BinaryType()),
        StructField("doc_ids", ArrayType(id_type)), StructField("lengths", ArrayType(LongType()))])
    arrow = spark.createDataFrame([], schema).toArrow().schema
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = partitions_for(spark, docs.count(), DOCS_PER_SHARD)
    (whole.repartitionByRange(shards, "id").sortWithinPartitions("id")
     .mapInArrow(_blocks(tokenizer, end_id, arrow), schema)
     .write.mode("overwrite").option("compression", "uncompressed").parquet(path))


def _documents(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids = decode_block(row["n_tokens"].as_py(), *(
                    row[x].as_py() for x in ("ids_by_rank", "control", "data")))
                lengths = row["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e].astype("<u4")) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), row["shard"].as_py(), np.int32)),
                    pa.array(np.full(len(ends), row["block"].as_py(), np.int32)),
                    row["doc_ids"].values, pa.array(ends - lengths), pa.array(lengths),
                    pa.array(crc, pa.int64())], schema=out)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts all tokens of documents before it: totals of shards, then of blocks within
    a shard, then of documents within a block.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = StructType([
        StructField("shard", IntegerType()), StructField("block", IntegerType()),
        StructField("doc_id", id_type), StructField("local", LongType()),
        StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    arrow = spark.createDataFrame([], schema).toArrow().schema
    rows = files.mapInArrow(_documents(arrow), schema)

    def earlier(window):
        total = F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0))

    blocks = files.select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select(
        "shard", earlier(Window.orderBy("shard")).alias("of_shard"))
    starts = blocks.select("shard", "block", earlier(
        Window.partitionBy("shard").orderBy("block")).alias("of_block")).join(shards, "shard")
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("of_shard") + F.col("of_block") + F.col("local")).alias("start"),
        "n_tokens", "ids_crc32")
