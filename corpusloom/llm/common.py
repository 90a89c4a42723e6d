"""Small shared pieces: white space, tables, and word shingles as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the operators' contracts, as regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_SLICE_BYTES = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_kept: list[dict] = []


def kept_by_worker() -> dict:
    """A dict for what a worker process keeps between the tasks of one operator."""
    _kept.append({})
    return _kept[-1]


def forget_kept() -> None:
    """Free what tasks of other operators have left in this worker process."""
    if any(_kept):
        for held in _kept:
            held.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions for ``rows``, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


#: Bits of the filter in ``only_ids``: 262,144 rows of 64 bits, some 10 MB however many ids.
FILTER_BITS = 24


def _marked(rows: DataFrame, ids: DataFrame, id_col: str, wanted: bool) -> DataFrame:
    """Rows whose hashed id has its bit set in a bitmap of the hashes of ``ids``, or not set.

    The bitmap has a fixed size and goes to all tasks; it tells surely who is not in ``ids``.
    """
    names = [free_name(rows, x) for x in ("_slot", "_word", "_bits")]
    slot = F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS))
    bitmap = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("slot")).groupBy(
        F.shiftright("slot", 6).alias(names[1])).agg(F.bit_or(
            F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias(names[2]))
    at = F.col(names[0]).bitwiseAND(63).cast("int")
    bit = F.getbit(F.coalesce(F.col(names[2]), F.lit(0).cast("long")), at)
    return rows.withColumn(names[0], slot).withColumn(names[1], F.shiftright(names[0], 6)).join(
        F.broadcast(bitmap), names[1], "left").filter(bit == int(wanted)).select(
        *[F.col(f"`{c}`") for c in rows.columns])


def free_name(rows: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def possibly_in(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose ``id_col`` may be in the stored table ``ids`` (id): all that are, few others."""
    return _marked(rows, ids, id_col, True)


def only_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose ``id_col`` is in the stored table ``ids`` (id), null too, in one way at every size.

    Most other rows are left out by a bitmap before the join that decides is shuffled. The more
    ids, the less it leaves out; it never drops a wanted row.
    """
    maybe = _marked(rows, ids, id_col, True)
    mine = free_name(rows, "_wanted")
    # Not a semi-join: Spark would move that below the bitmap.
    listed = ids.select(F.col("id").alias(mine)).distinct().hint("merge")
    return maybe.join(listed, F.col(f"`{id_col}`").eqNullSafe(F.col(mine))).drop(mine)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose ``id_col`` is not in the stored table ``ids`` (id). Only rows that the bitmap
    cannot tell from those are shuffled."""
    unsure = _marked(rows, ids, id_col, True)
    mine = free_name(rows, "_listed")
    listed = ids.select(F.col("id").alias(mine)).distinct().hint("merge")
    # An outer join, as Spark would move an anti-join below the bitmap.
    rest = unsure.join(listed.withColumn(mine + "_", F.lit(True)), F.col(f"`{id_col}`").eqNullSafe(F.col(mine)),
                       "left").filter(F.col(mine + "_").isNull()).drop(mine, mine + "_")
    return _marked(rows, ids, id_col, False).union(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)
    starts = starts[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return starts, body


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about _SLICE_BYTES of text each, one row at least."""
    row, n = 0, len(starts) - 1
    while row < n:
        stop = int(np.searchsorted(starts, starts[row] + _SLICE_BYTES, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop
        row = stop


def word_hashes(body: np.ndarray, starts: np.ndarray,
                breaks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) of texts lower-cased in A-Z.

    ``starts`` bounds the rows within ``body``; ``breaks`` marks the bytes that end a word. A
    word's hash sums its bytes times a random odd weight per position, then mixes; words never
    reach across rows.
    """
    lo, hi = int(starts[0]), int(starts[-1])
    part = body[lo:hi]
    rows = starts - lo
    solid = ~breaks[part]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = rows[:-1][rows[:-1] < len(part)]
    first[edges] = solid[edges]
    begin = np.nonzero(first)[0]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.nonzero(solid)[0]
    word = np.cumsum(first)[at] - 1
    place = at - begin[word]
    weight = mix64(np.arange(int(place.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    value = (_LOWER[part[at]].astype(np.uint64) + np.uint64(1)) * weight[place]
    first_at = np.searchsorted(at, begin)
    hashes = mix64(np.add.reduceat(value, first_at))
    owner = np.searchsorted(rows, begin, side="right") - 1
    return owner, hashes


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bounds, hashes): sorted distinct shingle hashes of runs of rows.

    ``hashes[bounds[i]:bounds[i + 1]]`` belongs to row ``first + i``. A text of fewer than
    ``width`` words has its whole word sequence as one shingle; one without words has none.
    """
    starts, body = string_buffers(column)
    for row, stop in _pieces(starts):
        owner, words = word_hashes(body, starts[row:stop + 1])
        counts = np.bincount(owner, minlength=stop - row)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        shingle = np.zeros(len(words), np.uint64)
        size = np.minimum(counts, width)
        # Word j counts when its shingle starts at i and j < size of the row's shingles.
        left = firsts[1:][owner] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
        valid = left >= size[owner] if len(words) else np.zeros(0, bool)
        for j in range(width):
            inside = np.nonzero(valid & (size[owner] > j))[0] if len(words) else []
            if len(inside):
                shingle[inside] = mix64(shingle[inside] * np.uint64(31) + words[inside + j]
                                        + np.uint64(j + 1))
        own, found = owner[valid], shingle[valid]
        order = np.lexsort((found, own))
        own, found = own[order], found[order]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
        own, found = own[fresh], found[fresh]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=stop - row))])
        yield row, bounds, found


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def small_slices(batch: pa.RecordBatch, column: int = 1,
                 size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut by about ``size`` bytes of one string column, one row at least."""
    if len(batch):
        starts, _ = string_buffers(batch.column(column))
        group = (starts[1:] - starts[0]) // size
        cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(batch)]])
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(int(lo), int(hi - lo))
