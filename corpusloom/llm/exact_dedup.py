"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition keeps a short digest per row in the shared folder.
2. Each partition (a *sender*) sorts the fingerprints of its rows, splits them by *owner* (a
   range of values) and sends each owner one Golomb-coded list of distinct values. That is some
   ten bits and the logarithm of the number of senders per row, whatever the texts' length.
3. An owner merges the lists it got and answers each sender with a bitmap: which of its values
   came from elsewhere too. A sender adds what repeats among its own rows. Rows marked either
   way are suspects; a fingerprint that two texts share by chance only makes another suspect.
4. Only suspects' texts are shuffled and meet: grouped by the text itself, which compares the bytes. Partial
   aggregation keeps one row per task and text, so a text that fills a third of the corpus
   stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField,
                               StructType)

from corpusloom.llm.common import SPACE, forget_kept, only_ids, partitions_for
from corpusloom.session import materialize

#: Bits of a fingerprint beyond the logarithm of the number of rows: of 256 rows about one
#: becomes a suspect by chance.
SPARE_BITS = 8
ROWS_PER_OWNER = 4_000_000
ROWS_PER_LIST = 1_000_000


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, int, bytes]:
    """(k, bits of the unary part, payload) of sorted distinct integers in [0, span).

    Gaps are split into a quotient by 2**k, in unary, and k low bits. Unary part and low bits
    follow each other, each filled up to a byte.
    """
    n = len(values)
    k = max(0, int(math.log2(max(1, span // max(1, n)))))
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    stops = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(stops[-1]) if n else 0, np.uint8)
    unary[stops - 1] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, len(unary), np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary_bits: int, payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    split = -(-unary_bits // 8)
    stops = np.nonzero(np.unpackbits(raw[:split], count=unary_bits))[0] + 1
    low = np.unpackbits(raw[split:], count=n * k).reshape(n, k).astype(np.int64)
    gaps = ((np.diff(stops, prepend=0) - 1) << k) + low @ (np.int64(1) << np.arange(k))
    return np.cumsum(gaps + 1) - 1


def _lists(bits: int, owners: int, out: pa.Schema):
    """mapInArrow: rows (id, fingerprint) to one list per owner and run of rows."""

    def flush(sender: int, ids: list, prints: list) -> pa.RecordBatch:
        id_values = pa.concat_arrays(ids)
        values = np.concatenate(prints) >> np.uint64(64 - bits)
        order = np.argsort(values, kind="stable")
        distinct, first, counts = np.unique(values[order], return_index=True, return_counts=True)
        owner = (distinct * np.uint64(owners)) >> np.uint64(bits)
        cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        row_at = np.append(first, len(values))
        slot_of_row = np.repeat(np.arange(len(distinct)), counts)
        rows = []
        for o in np.nonzero(np.diff(cuts))[0]:
            lo, hi = cuts[o], cuts[o + 1]
            base = -(-(int(o) << bits) // owners)
            k, unary, payload = golomb_encode(
                (distinct[lo:hi] - np.uint64(base)).astype(np.int64), (1 << bits) // owners + 1)
            a, b = row_at[lo], row_at[hi]
            rows.append((int(o), sender, int(hi - lo), k, unary, payload,
                         id_values.take(pa.array(order[a:b])),
                         pa.array(slot_of_row[a:b] - lo, pa.int32()),
                         np.packbits(counts[lo:hi] > 1).tobytes()))
        columns = list(zip(*rows))
        bounds = np.cumsum([0] + [len(x) for x in columns[6]])
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.concat_arrays(c))
                 for c in columns[6:8]]
        plain = [pa.array(c, out.field(i).type) for i, c in enumerate(columns[:6])]
        return pa.RecordBatch.from_arrays(
            [*plain, *lists, pa.array(columns[8], pa.binary())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        sender = TaskContext.get().partitionId() << 24
        ids, prints, held = [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            prints.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(batch)
            if held >= ROWS_PER_LIST:
                yield flush(sender, ids, prints)
                ids, prints, held, sender = [], [], 0, sender + 1
        if held:
            yield flush(sender, ids, prints)

    return run


def _answers(lists: pa.Table) -> pa.Table:
    """One owner: which values of each list another list has too, as bitmaps."""
    rows = lists.to_pylist()
    values = [golomb_decode(r["n"], r["k"], r["unary"], r["payload"]) for r in rows]
    _, where, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = counts[where] > 1
    cuts = np.cumsum([0] + [len(v) for v in values])
    return pa.table({
        "owner": pa.array([r["owner"] for r in rows], pa.int32()),
        "sender": pa.array([r["sender"] for r in rows], pa.int64()),
        "shared": pa.array([np.packbits(shared[a:b]).tobytes()
                            for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _suspects(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n")[i].as_py()
                marked = [np.unpackbits(np.frombuffer(batch.column(c)[i].as_py(), np.uint8), count=n)
                          for c in ("local", "shared")]
                slots = batch.column("slots")[i].values.to_numpy()
                hit = np.nonzero((marked[0] | marked[1])[slots])[0]
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("ids")[i].values.take(pa.array(hit))], schema=out)

    return run


def suspects(digests: DataFrame) -> DataFrame:
    """Ids of rows whose shortened fingerprint occurs more than once.

    ``digests`` is a stored table with columns ``id`` and ``print`` (64 random bits).
    """
    spark = digests.sparkSession
    n = digests.count()
    bits = min(48, max(16, max(1, n).bit_length() + SPARE_BITS))
    owners = partitions_for(spark, n, ROWS_PER_OWNER)
    id_type = digests.schema["id"].dataType
    schema = StructType([
        StructField("owner", IntegerType()), StructField("sender", LongType()),
        StructField("n", IntegerType()), StructField("k", IntegerType()),
        StructField("unary", IntegerType()), StructField("payload", BinaryType()),
        StructField("ids", ArrayType(id_type)), StructField("slots", ArrayType(IntegerType())),
        StructField("local", BinaryType())])
    arrow = spark.createDataFrame([], schema).toArrow().schema
    lists = materialize(
        digests.select("id", "print").mapInArrow(_lists(bits, owners, arrow), schema), "lists")
    answers = lists.select("owner", "sender", "n", "k", "unary", "payload").groupBy(
        "owner").applyInArrow(_answers, "owner int, sender long, shared binary")
    found = StructType([StructField("id", id_type)])
    return lists.select("owner", "sender", "n", "ids", "slots", "local").join(
        answers, ["owner", "sender"]).mapInArrow(
            _suspects(spark.createDataFrame([], found).toArrow().schema), found)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after every run of white space became one blank; the one with
    the smallest id stays. A null text counts as empty, so null, "" and nothing else are
    equal; " " normalises to one blank and differs from "". Rows without an id count in
    their group but only stay if no row of it has an id. Rows that repeat an id with the same
    text all get that id and count one by one. Other columns of ``docs`` are not looked at. An
    empty table gives an empty result.
    """
    whole = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.regexp_replace("text", SPACE, " ")
    digests = materialize(whole.select(
        "id", F.xxhash64(text).alias("print"), F.sha2(text.cast("binary"), 256).alias("sha")),
        "digests")
    marked = materialize(suspects(digests).distinct(), "suspects")
    groups = (
        only_ids(whole, marked)
        .groupBy(text.alias("text")).agg(F.min("id").alias("keep"), F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
        .agg(F.min("keep").alias("keep"), F.max("n").alias("n"), F.count("*").alias("texts"))
        .select("sha", "keep", F.when(F.col("texts") == 1, F.col("n")).otherwise(
            F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).alias("n")))
    keep = F.coalesce("keep", "id")
    return digests.join(groups, "sha", "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
