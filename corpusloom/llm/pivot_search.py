"""Exact search for the largest inner products through an index of pivots and distances.

A vector is keyed by its nearest pivot and its distance to it. Sorted by these keys, vectors are
cut into blocks: thin rings (annuli) around a pivot. For a query q and a ring between distances
lo and hi of pivot p, the triangle inequality gives the least distance of q to any vector in
it, g = max(0, lo - d(q, p), d(q, p) - hi), so no inner product there exceeds
(|q|^2 + most^2 - g^2) / 2, with most the largest norm in the ring.

A query is itself a row of the index. Its own ring gives the first k answers and so a limit. A
task takes the rings of its partition, some at a time, and expands them for every query in the order
of their bounds; scores are computed exactly, limits rise with the answers, and a query stops at
the first ring whose bound stays below its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField,
                               StructType)

from corpusloom.llm.common import partitions_for
from corpusloom.operators.ranking import top_k_per_group
from corpusloom.session import materialize, new_path

SCALE = 1024
#: Pivots are centres of a sample of at most this many vectors; every vector is indexed.
SAMPLE = 20_000
RING_ROWS = 1024
ROWS_PER_PARTITION = 100_000
#: Queries are sent to the tasks in blocks of this size.
QUERY_BLOCK_BYTES = 16 << 20
#: Rings that a task holds and orders at once.
HELD_RINGS = 64
_SETTLE = 1_000_000


def _numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their scaled whole components, short rows filled up with zeros)."""
    lists = column.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    bad_value = pc.is_null(flat).to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
    bad_value |= ~np.isfinite(scaled)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out = np.zeros((len(lists), dims))
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    out[row, place] = np.where(bad_value, 0, scaled)
    fine = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    fine[row[bad_value]] = False
    return np.nonzero(fine)[0], out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres by a few rounds of k-means from evenly spaced rows; any pivots are correct."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(5):
        nearest = np.argmin(squared_distances(sample, pivots), axis=1)
        for c in np.unique(nearest):
            pivots[c] = sample[nearest == c].mean(0)
    return pivots


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def _keyed(pivots: np.ndarray, dims: int, dtype: str, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                fine, vectors = _numbers(part.column(1), dims)
                vectors = vectors[fine]
                far = squared_distances(vectors, pivots)
                cell = np.argmin(far, axis=1)
                whole = vectors.astype(dtype)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(fine)), pa.array(cell.astype(np.int32)),
                    pa.array(np.sqrt(far[np.arange(len(fine)), cell])),
                    pa.array([v.tobytes() for v in whole], pa.binary())], schema=out)

    return run


def _rings(dims: int, dtype: str, out: pa.Schema):
    """Sorted keyed rows to one row per ring; a ring stays in one cell."""

    def close(cell: int, ids: np.ndarray, far: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        vectors = np.frombuffer(b"".join(raw), dtype).reshape(-1, dims).astype(np.float64)
        return pa.RecordBatch.from_arrays([
            pa.array([cell], pa.int32()), pa.array([far.min()]), pa.array([far.max()]),
            pa.array([float(np.sqrt((vectors * vectors).sum(1).max()))]),
            pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary())],
            schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, cells, far = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw = batch.column(3).to_pylist()
            cuts = np.concatenate([[0], np.nonzero(np.diff(cells))[0] + 1, [len(cells)]])
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (held[0] != cells[lo] or len(held[1]) >= RING_ROWS):
                        yield close(*held)
                        held = None
                    room = RING_ROWS - (len(held[1]) if held else 0)
                    stop = min(hi, lo + room)
                    piece = (ids[lo:stop], far[lo:stop], raw[lo:stop])
                    held = (cells[lo], *(piece if not held else (
                        np.concatenate([held[1], piece[0]]), np.concatenate([held[2], piece[1]]),
                        held[3] + piece[2])))
                    lo = stop
        if held:
            yield close(*held)

    return run


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where every sum is exact, else by integers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _limits(every: int, k: int, dims: int, dtype: str, out: pa.Schema):
    """Each query with its k-th best (score, id) in its own ring, if the ring has that many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("ids")[i].values.to_numpy()
                asked = np.nonzero(ids % every == 0)[0]
                if not len(asked):
                    continue
                vectors = np.frombuffer(batch.column("vectors")[i].as_py(), dtype).reshape(-1, dims)
                scores = exact_scores(vectors[asked], vectors)
                rows = []
                for q, row in zip(asked, scores):
                    other = ids != ids[q]
                    s, o = row[other], ids[other]
                    best = np.lexsort((o, -s))[:k]
                    full = len(best) == k
                    rows.append((int(ids[q]), vectors[q].tobytes(),
                                 int(s[best[-1]]) if full else None, int(o[best[-1]]) if full else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

    return run


class Answers:
    """Per query the best k (score, id) so far and the limit that the k-th sets."""

    def __init__(self, ids: np.ndarray, score: np.ndarray, last: np.ndarray, k: int):
        self.ids, self.score, self.last, self.k = ids, score.copy(), last.copy(), k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least, last = self.score[queries][:, None], self.last[queries][:, None]
        better = (scores > least) | ((scores == least) & (ids[None, :] <= last))
        better &= ids[None, :] != self.ids[queries][:, None]
        q, v = np.nonzero(better)
        if len(q):
            self.parts.append((queries[q], scores[q, v], ids[v]))
            self.held += len(q)
            if self.held > _SETTLE:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        q, s, v = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        begin = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1])
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = place < self.k
        q, s, v, place = q[keep], s[keep], v[keep], place[keep]
        full = place == self.k - 1
        self.score[q[full]], self.last[q[full]] = s[full], v[full]
        self.parts, self.held = [(q, s, v)], 0
        return q, s, v


@dataclass
class Ring:
    cell: int
    lo: float
    hi: float
    most: float
    ids: np.ndarray
    vectors: np.ndarray


def expand(answers: Answers, asked: np.ndarray, pivots: np.ndarray, rings: list[Ring]) -> int:
    """Offer the rings to all queries, each in the order of its bounds until one is below its
    limit; gives the number of pairs of query and ring that were looked at."""
    vectors = asked.astype(np.float64)
    squares = (vectors * vectors).sum(1)
    cells = np.array([r.cell for r in rings])
    held, cell = np.unique(cells, return_inverse=True)
    away = np.sqrt(squared_distances(vectors, pivots[held]))[:, cell]
    lo, hi, most = (np.array([getattr(r, x) for r in rings]) for x in ("lo", "hi", "most"))
    gap = np.maximum(0, np.maximum(lo - away, away - hi))
    total = squares[:, None] + most ** 2
    bound = (total - gap * gap) / 2 + 1 + 1e-9 * total  # with room for rounding
    order = np.argsort(-bound, axis=1, kind="stable")
    going = np.arange(len(asked))
    looked = 0
    for step in range(len(rings)):
        ring = order[going, step]
        more = bound[going, ring] >= answers.score[going]
        going, ring = going[more], ring[more]
        if not len(going):
            break
        looked += len(going)
        turn = np.argsort(ring, kind="stable")
        cuts = np.nonzero(np.diff(ring[turn]))[0] + 1
        for queries in np.split(going[turn], cuts):
            here = rings[order[queries[0], step]]
            for at in range(0, len(queries), 2048):
                some = queries[at:at + 2048]
                answers.offer(some, exact_scores(asked[some], here.vectors), here.ids)
        answers.settle()
    return looked


def _search(sent, pivots: np.ndarray, dims: int, dtype: str, k: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, score, last = sent.value
        answers = Answers(ids, score, last, k)
        held: list[Ring] = []
        for batch in batches:
            for i in range(len(batch)):
                held.append(Ring(*(batch.column(c)[i].as_py() for c in ("cell", "lo", "hi", "most")),
                                 batch.column("ids")[i].values.to_numpy(),
                                 np.frombuffer(batch.column("vectors")[i].as_py(), dtype).reshape(-1, dims)))
                if len(held) == HELD_RINGS:
                    expand(answers, vectors, pivots, held)
                    held = []
        if held:
            expand(answers, vectors, pivots, held)
        q, s, v = answers.settle()
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(v), pa.array(s)], schema=out)

    return run


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products.

    Components count as floor(1024 * x). Queries are rows whose id is divisible by ``every``,
    candidates all rows of another id; equal scores go to the smaller id. Rows without an id,
    without a vector, or with a null or non-finite component take no part. Shorter vectors count
    as filled up with zeros. Rows that repeat an id are candidates each; as a query the id is asked
    once, with the least of its vectors in byte order. Scores must fit 64 bits. Other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(
        "array<double>").alias("v")).filter("id is not null and v is not null")
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(
        F.transform(F.filter("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.abs)))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    dims = max(1, dims)
    dtype = "<i4" if (largest or 0) * SCALE < (1 << 31) - 1 else "<i8"

    def arrow(schema: StructType) -> pa.Schema:
        return spark.createDataFrame([], schema).toArrow().schema

    sample = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).toArrow()
    fine, numbers = _numbers(sample.column("v").combine_chunks(), dims)
    if not len(fine):
        numbers, fine = np.zeros((1, dims)), np.array([0])
    pivots = choose_pivots(numbers[fine], int(min(1024, max(16, n ** 0.5 / 2))))

    keyed = StructType([StructField("id", LongType()), StructField("cell", IntegerType()),
                        StructField("far", DoubleType()), StructField("vector", BinaryType())])
    ring = StructType([StructField("cell", IntegerType()), StructField("lo", DoubleType()),
                       StructField("hi", DoubleType()), StructField("most", DoubleType()),
                       StructField("ids", ArrayType(LongType())), StructField("vectors", BinaryType())])
    keys = materialize(rows.mapInArrow(_keyed(pivots, dims, dtype, arrow(keyed)), keyed), "keyed")
    index = materialize(
        keys.repartitionByRange(partitions_for(spark, n, ROWS_PER_PARTITION), "cell", "far", "id")
        .sortWithinPartitions("cell", "far", "id")
        .mapInArrow(_rings(dims, dtype, arrow(ring)), ring), "rings")

    query = StructType([StructField("id", LongType()), StructField("vector", BinaryType()),
                        StructField("score", LongType()), StructField("last", LongType())])
    found = index.mapInArrow(_limits(every, k, dims, dtype, arrow(query)), query)
    asked = materialize(found.groupBy("id").agg(F.min(F.struct("vector", "score", "last")).alias("q")).select(
        "id", "q.*"), "queries")
    per_block = max(1, QUERY_BLOCK_BYTES // (dims * np.dtype(dtype).itemsize + 24))
    blocks = max(1, -(-asked.count() // per_block))
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    hit = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()),
                      StructField("score", LongType())])
    path = new_path(spark, "hits")
    for b in range(blocks):
        part = asked.filter(block_of == b).select("id", "vector", "score", "last").toArrow()
        if not part.num_rows:
            continue
        raw = b"".join(part.column("vector").to_pylist())
        least = np.iinfo(np.int64).min
        sent = spark.sparkContext.broadcast((
            part.column("id").to_numpy(), np.frombuffer(raw, dtype).reshape(-1, dims),
            part.column("score").fill_null(least).to_numpy(),
            part.column("last").fill_null(np.iinfo(np.int64).max).to_numpy()))
        index.mapInArrow(_search(sent, pivots, dims, dtype, k, arrow(hit)), hit).write.mode(
            "append").parquet(path)
        sent.unpersist()
    if not asked.head(1):
        return spark.createDataFrame([], result)
    hits = spark.read.schema(hit).parquet(path)
    return top_k_per_group(hits, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select(
        "query_id", "rank", "vec_id", "score")

