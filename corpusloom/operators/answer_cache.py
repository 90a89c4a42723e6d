"""Semantic answer cache kept as a table: lookup, fill, eviction, invalidation.

Rows: kb_id, seq, question, embedding, answer, sources, created_at. ``seq`` grows with every
insert and stands for insertion order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusloom.functions.vectors import matrix_of, unit_rows
from corpusloom.operators.ranking import top_k_per_group
from corpusloom.operators.scan import row_slices
from corpusloom.session import materialize, read_or_empty

# Similarity that counts as the same question, rows kept per kb.
THRESHOLD = 0.90
CAPACITY = 200
_DIGITS = 6
#: Pivots that go to all tasks at once.
BLOCK_BYTES = 64 << 20


def evict(cache: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Keep the newest ``capacity`` rows of each kb by insertion order."""
    return top_k_per_group(cache, ["kb_id"], [F.desc("seq")], capacity, "_age").drop("_age")


def insert(cache: DataFrame, entries: DataFrame, enabled: bool = True,
           capacity: int = CAPACITY) -> DataFrame:
    """Append entries that have an answer, then evict. Duplicates are allowed."""
    if not enabled:
        return cache
    fresh = entries.filter(F.length("answer") > 0)
    return evict(cache.unionByName(fresh, allowMissingColumns=True), capacity)


def invalidate(cache: DataFrame, changed_kbs: DataFrame) -> DataFrame:
    """Drop every row of the kbs whose chunks changed."""
    return cache.join(changed_kbs.select("kb_id"), "kb_id", "left_anti")


def fill(cache: DataFrame, answered: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The cache after its misses were answered elsewhere.

    ``answered``: the cache's columns and has_history. Answers that depend on a history are refused;
    empty ones are not kept.
    """
    alone = answered.filter(~F.coalesce(F.col("has_history"), F.lit(False)))
    return insert(cache, alone.select(*cache.columns), capacity=capacity)


class CacheStore:
    """The cache as numbered versions below one path, each a folder written whole.

    A reader takes the last finished version and keeps it while a writer publishes the next, so
    long jobs and streams see one state of the cache and pick up the next when they start anew.
    The last ``keep`` versions stay; there is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def versions(self) -> list[int]:
        """Numbers of the finished versions, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def current(self) -> DataFrame:
        """The last finished version; no rows before the first."""
        found = self.versions()
        return read_or_empty(self.spark, self._folder(found[-1] if found else 0), self.schema)

    def publish(self, cache: DataFrame) -> int:
        """Make a table the next version; returns its number."""
        found = self.versions()
        version = (found[-1] if found else 0) + 1
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        cache.select(*names).write.mode("overwrite").parquet(self._folder(version))
        files = self.spark._jvm.org.apache.hadoop.fs
        for old in found[:max(0, len(found) + 1 - self.keep)]:
            target = files.Path(self._folder(old))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return version

    def insert(self, entries: DataFrame, capacity: int = CAPACITY) -> int:
        return self.publish(insert(self.current(), entries, capacity=capacity))

    def invalidate(self, changed_kbs: DataFrame) -> int:
        return self.publish(invalidate(self.current(), changed_kbs))


class _Shelf:
    """Cached rows of one shelf, by cell, against which questions are held."""

    def __init__(self, rows: pa.Table, pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.seq = rows.column("seq").to_numpy()
        lists = rows.column("_cached").combine_chunks()
        self.known = unit_rows(matrix_of(lists, len(lists[0])))
        cell = rows.column("_cell").to_numpy()
        self.begins = np.nonzero(np.diff(cell, prepend=-1))[0]
        self.ends = np.append(self.begins[1:], len(cell))
        own = cell[self.begins]
        self.pivots, self.lo, self.hi = pivots[own], lo[own], hi[own]

    def best(self, lists: pa.Array, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, seq) of every question's best row, -inf where none is similar enough.

        Only rows of cells within reach are compared.
        """
        asked = unit_rows(matrix_of(lists, self.known.shape[1]))
        best, seq = np.full(len(asked), -np.inf), np.zeros(len(asked), np.int64)
        near = np.concatenate([_reached(asked[part], self.pivots, self.lo, self.hi, reach)
                               for part in row_slices(len(asked), len(self.pivots))])
        for cell, (begin, end) in enumerate(zip(self.begins, self.ends)):
            wanted, rows = np.nonzero(near[:, cell])[0], self.known[begin:end].T
            for part in row_slices(len(wanted), end - begin):
                raw = asked[wanted[part]] @ rows
                hit = np.nonzero(raw.max(axis=1) >= threshold)[0]
                if not len(hit):
                    continue
                raw, who = raw[hit], wanted[part][hit]
                # The threshold is held against the similarity itself; it is rounded to rank.
                scores = np.where(raw >= threshold, np.round(raw, _DIGITS) + 0.0, -np.inf)
                # A cell's rows come in seq order, so the last maximum is the latest row.
                at = scores.shape[1] - 1 - np.argmax(scores[:, ::-1], axis=1)
                top, latest = scores[np.arange(len(at)), at], self.seq[begin + at]
                more = (top > best[who]) | (top == best[who]) & (latest > seq[who])
                best[who[more]], seq[who[more]] = top[more], latest[more]
        return best, seq


def _match_groups(cells: Cells, threshold: float, out: pa.Schema):
    """Function for ``mapInArrow`` over rows sorted by group, cache rows before questions.

    Gives one row per question with a similar enough row on the group's shelf of the cache.
    """
    reach = _reach(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pieces, shelf = None, [], None
        for batch in batches:
            kbs = batch.column("kb_id").dictionary_encode()
            kb_at = kbs.indices.to_numpy(zero_copy_only=False)
            place = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_shelf", "_part", "_asked")]
            turns = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
            for at in (kb_at, *place):
                turns |= np.diff(at) != 0
            starts = [0, *(np.nonzero(turns)[0] + 1).tolist()]
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                if start == stop:
                    continue
                rows = batch.slice(start, stop - start)
                kb = kbs.dictionary[int(kb_at[start])].as_py()
                here = (kb, *(int(p[start]) for p in place[:2]))
                if here != group:
                    group, pieces, shelf = here, [], None
                if place[2][start] == 0:
                    pieces.append(rows.select(["_cached", "seq", "_cell"]))
                    continue
                if shelf is None and pieces:
                    shelf = _Shelf(pa.Table.from_batches(pieces), cells.pivots[kb], cells.lo[kb], cells.hi[kb])
                    pieces = []
                if shelf is None:
                    continue
                best, seq = shelf.best(rows.column("embedding"), threshold, reach)
                hit = np.nonzero(best > -np.inf)[0]
                if len(hit):
                    found = rows.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([
                        found.column("query_id").cast(out.field(0).type),
                        found.column("kb_id").cast(out.field(1).type), pa.array(best[hit]),
                        pa.array(seq[hit])], schema=out)

    return run


@dataclass
class Cells:
    """Pivots per kb; of the cached rows nearest to each their angles to it and their number in blocks.

    Blocks are numbered through the cells of a kb, and ``per_shelf`` of them make a shelf.
    """

    pivots: dict[str, np.ndarray]
    lo: dict[str, np.ndarray]
    hi: dict[str, np.ndarray]
    blocks: dict[str, np.ndarray]
    per_shelf: int

    def shelves(self, kb: str) -> np.ndarray:
        """Cells x shelves: whether a cell has blocks on a shelf."""
        ends = np.cumsum(self.blocks[kb])
        first, last = (ends - self.blocks[kb]) // self.per_shelf, (ends - 1) // self.per_shelf
        at = np.arange(last.max() + 1)
        return (first[:, None] <= at) & (at <= last[:, None]) & (self.blocks[kb] > 0)[:, None]


def _reach(threshold: float) -> float:
    """The largest angle of two vectors that are similar enough."""
    # Angles are known to some 1e-8. Vectors of length 0 have a cosine of 0 with all.
    return np.arccos(min(1.0, threshold)) + 1e-6 if threshold > 0 else np.pi


def _reached(questions: np.ndarray, pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: float) -> np.ndarray:
    """Questions x cells: whether a row of the cell may lie within ``reach`` of the question.

    A row is lo to hi from its pivot, so by the triangle inequality it is farther from a
    question whose own angle to the pivot is not within ``reach`` of that range.
    """
    away = np.arccos(np.clip(questions @ pivots.T, -1, 1))
    return (away - reach <= hi) & (away + reach >= lo)


def _by_kb(kbs: pa.Array):
    """(kb, positions) of every kb in a column."""
    coded = kbs.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for i, kb in enumerate(coded.dictionary.to_pylist()):
        yield kb, np.nonzero(codes == i)[0]


def cell_cache(cache: DataFrame, rows_per_block: int,
               block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Cells]:
    """(the cache with ``_cell``, its cells): every row goes to the nearest pivot of its kb.

    About one row in ``rows_per_block`` is a pivot, by the hash of its number, fewer where so many
    would not fit ``block_bytes``; and the first by hash in every kb. Pivots go to all tasks.
    A shelf holds about half of ``block_bytes`` of vectors, one block at least.
    """
    n, width = cache.agg(F.count("*"), F.max(F.size("embedding"))).first()
    rows_per_pivot = max(rows_per_block, (n or 0) * (width or 0) * 8 // block_bytes)
    turn = F.xxhash64("kb_id", "seq")
    vector = F.col("embedding").cast("array<double>")
    chosen = cache.filter(F.pmod(turn, F.lit(rows_per_pivot)) == 0).select("kb_id", vector.alias("v")).union(
        cache.groupBy("kb_id").agg(F.min_by(vector, turn).alias("v"))).toArrow()
    pivots: dict[str, np.ndarray] = {}
    for kb, at in _by_kb(chosen.column("kb_id").combine_chunks()):
        lists = chosen.column("v").combine_chunks().take(pa.array(at))
        pivots[kb] = np.unique(unit_rows(matrix_of(lists, len(lists[0]))), axis=0)

    @F.arrow_udf("struct<cell: int, angle: double>")
    def nearest(kbs: pa.Array, lists: pa.Array) -> pa.Array:
        cell, angle = np.zeros(len(kbs), np.int32), np.zeros(len(kbs))
        for kb, at in _by_kb(kbs):
            own = pivots[kb]
            vectors = unit_rows(matrix_of(lists.take(pa.array(at)), own.shape[1]))
            for part in row_slices(len(at), len(own)):
                cosines = vectors[part] @ own.T
                cell[at[part]] = cosines.argmax(1)
                angle[at[part]] = np.arccos(np.clip(cosines.max(1), -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], names=["cell", "angle"])

    placed = materialize(cache.withColumn("_place", nearest(F.col("kb_id"), vector)).withColumn(
        "_cell", F.col("_place.cell")), "cache-cells")
    held = placed.groupBy("kb_id", "_cell").agg(
        F.count("*").alias("n"), F.min("_place.angle").alias("lo"), F.max("_place.angle").alias("hi")).toArrow()
    cells = Cells(pivots, {}, {}, {}, max(1, block_bytes // 2 // max(1, (width or 0) * 8 * rows_per_block)))
    for kb, at in _by_kb(held.column("kb_id").combine_chunks()):
        own = held.take(pa.array(at))
        where, size = own.column("_cell").to_numpy(), len(pivots[kb])
        for into, values, nothing in ((cells.lo, own.column("lo").to_numpy(), np.inf),
                                      (cells.hi, own.column("hi").to_numpy(), -np.inf),
                                      (cells.blocks, -(-own.column("n").to_numpy() // rows_per_block), 0)):
            into[kb] = np.full(size, nothing, dtype=values.dtype if nothing == 0 else float)
            into[kb][where] = values
    return placed.drop("_place"), cells


def asked_blocks(questions: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """(query_id, kb_id, embedding, _shelf): the shelves that may hold an answer for a question."""
    reach = _reach(threshold)

    @F.arrow_udf("array<int>")
    def reached(kbs: pa.Array, lists: pa.Array) -> pa.Array:
        out: list = [[] for _ in range(len(kbs))]
        for kb, at in _by_kb(kbs):
            if kb in cells.pivots:
                vectors = unit_rows(matrix_of(lists.take(pa.array(at)), cells.pivots[kb].shape[1]))
                shelves = cells.shelves(kb).astype(np.float32)
                for part in row_slices(len(at), len(shelves)):
                    near = _reached(vectors[part], cells.pivots[kb], cells.lo[kb], cells.hi[kb], reach)
                    for row, mine in zip(at[part], near.astype(np.float32) @ shelves):
                        out[row] = np.nonzero(mine)[0].tolist()
        return pa.array(out, pa.list_(pa.int32()))

    vector = F.col("embedding").cast("array<double>")
    return questions.select("query_id", "kb_id", vector.alias("embedding"), F.explode(
        reached(F.col("kb_id"), vector)).alias("_shelf"))


def _shelf_of(cells: Cells) -> Column:
    """The shelf of a cached row: blocks of its cell take rows by the hash of their number."""

    @F.arrow_udf("int")
    def shelf(kbs: pa.Array, cell: pa.Array, turn: pa.Array) -> pa.Array:
        out = np.zeros(len(kbs), np.int32)
        own, turns = cell.to_numpy(zero_copy_only=False), turn.to_numpy(zero_copy_only=False)
        for kb, at in _by_kb(kbs):
            blocks = cells.blocks[kb]
            first = np.cumsum(blocks) - blocks
            out[at] = (first[own[at]] + turns[at] % blocks[own[at]]) // cells.per_shelf
        return pa.array(out)

    return shelf(F.col("kb_id"), F.col("_cell"), F.xxhash64("seq"))


def _best_answers(cache: DataFrame, questions: DataFrame, threshold: float, rows_per_part: int,
                  rows_per_block: int, block_bytes: int) -> DataFrame:
    """(query_id, kb_id, hit, similarity, seq) of the questions with an answer."""
    parts = materialize(questions.groupBy("kb_id").agg(
        F.ceil(F.count("*") / rows_per_part).cast("int").alias("_parts")), "question-parts")
    placed, cells = cell_cache(cache.join(parts, "kb_id", "left_semi"), rows_per_block, block_bytes)
    live = placed.withColumn("_shelf", _shelf_of(cells)).join(parts, "kb_id").select(
        "kb_id", "_shelf", "_cell", F.col("embedding").alias("_cached"), F.col("seq").cast("long").alias("seq"),
        F.lit(0).alias("_asked"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    asked = asked_blocks(questions, cells, threshold).join(parts, "kb_id").select(
        "kb_id", "_shelf", "query_id", "embedding", F.lit(1).alias("_asked"),
        F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int").alias("_part"))
    out = StructType([questions.schema["query_id"], questions.schema["kb_id"],
                      StructField("similarity", DoubleType()), StructField("seq", LongType())])
    keys = ("kb_id", "_shelf", "_part")
    return (
        live.unionByName(asked, allowMissingColumns=True)
        .repartition(*keys).sortWithinPartitions(*keys, "_asked", "_cell", "seq")
        .mapInArrow(_match_groups(cells, threshold, to_arrow_schema(out)), out)
        .groupBy("query_id", "kb_id").agg(F.max(F.struct("similarity", "seq")).alias("_best"))
        .select("query_id", "kb_id", F.lit(True).alias("hit"), "_best.*")
    )


def lookup(cache: DataFrame, questions: DataFrame, threshold: float = THRESHOLD,
           rows_per_part: int = 100_000, rows_per_block: int = 20_000,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every question with the most similar cached answer of its kb, or nulls on a miss.

    All rows of the kb's cache count; only ``insert`` and ``evict`` limit how many there are. Of
    equally similar rows the later one wins. A kb's cache is cut into cells around pivots, these
    into blocks of ``rows_per_block``, and many blocks make a shelf. A question goes once to every
    shelf with a cell that the triangle inequality lets hold a row of the ``threshold``, and is
    compared there with the rows of such cells. The questions of a kb are cut into parts of about
    ``rows_per_part``. A part and a shelf are shuffled to one task and sorted so that the shelf
    comes first; the questions then stream past it. No pair of question and cached row or block
    ever becomes a row: a shelf gives its best row per question, and these are reduced to one.
    More kbs than ``block_bytes`` hold a pivot of each take further passes over their own rows.

    ``questions``: query_id, kb_id, embedding and more; a pair of query_id and kb_id names one question.
    ``seq`` is unique within a kb. Output adds hit, similarity, seq, answer and, if the cache has
    them, sources.
    """
    carried = [c for c in ("answer", "sources") if c in cache.columns]
    asking = questions.filter("kb_id is not null")
    n_kbs, width = asking.agg(F.countDistinct("kb_id"), F.max(F.size("embedding"))).first()
    passes = max(1, -(-n_kbs * (width or 0) * 8 // block_bytes))
    found = None
    for i in range(passes):
        mine = F.pmod(F.xxhash64("kb_id"), F.lit(passes)) == i
        part = _best_answers(cache.select("kb_id", "seq", "embedding").filter(mine), asking.filter(mine), threshold,
                             rows_per_part, rows_per_block, block_bytes)
        found = part if found is None else found.unionByName(part)
    answers = cache.select("kb_id", F.col("seq").cast("long").alias("seq"), *carried)
    return questions.join(found.join(answers, ["kb_id", "seq"]), ["query_id", "kb_id"], "left").select(
        *questions.columns, F.coalesce("hit", F.lit(False)).alias("hit"), "similarity", "seq", *carried)


def route(cache: DataFrame, questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``branch``: ``bypass`` for questions with history, else ``hit`` or ``miss``.

    ``questions`` also carries has_history. Only questions without history consult the
    cache, and only those may fill it: a hit has its answer and sources, the others are to be
    answered, and ``fill`` takes the misses back.
    """
    alone = lookup(cache, questions.filter(~F.col("has_history")), threshold)
    asked = alone.withColumn("branch", F.when(F.col("hit"), "hit").otherwise("miss"))
    bypass = questions.filter(F.col("has_history")).withColumn("branch", F.lit("bypass"))
    return asked.drop("hit").unionByName(bypass, allowMissingColumns=True)
