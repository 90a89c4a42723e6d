"""Text vectors, dense top-k, an approximate form, and a width check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import tokenize
from corpusloom.functions.vectors import matrix_of, unit_rows
from corpusloom.operators.scan import BLOCK_BYTES, row_slices, scan_top_k
from corpusloom.session import materialize

VECTOR_WIDTH = 256


def slots_of(words: pa.Array, width: int) -> np.ndarray:
    """Slot of every word: the first four bytes of its MD5, modulo ``width``."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2].to_pybytes() if len(words) and words.buffers()[2] else b""
    at = ends.tolist()
    digests = b"".join([md5(data[i:j]).digest() for i, j in zip(at, at[1:])])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) % width


def slot_counts(lists: pa.Array, width: int, tokens: pa.DictionaryArray | None = None) -> np.ndarray:
    """Texts x slots token counts. Each distinct token of an Arrow batch is hashed once.

    ``tokens``: those of all lists, where they are encoded already.
    """
    tokens = lists.flatten().dictionary_encode() if tokens is None else tokens
    row_of = np.repeat(np.arange(len(lists)),
                       lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cell = row_of * width
    if len(cell):
        slots = slots_of(tokens.dictionary, width)
        cell = cell + slots[tokens.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(cell, minlength=len(lists) * width).reshape(len(lists), width)


def _to_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _slot_frequencies(width: int, held_kbs: int = 10_000):
    """Function for ``mapInArrow``: per task and kb, how many texts fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "kb_id": pa.array(list(found), pa.string()),
                "dfs": _to_lists(np.array([df for df, _ in found.values()], dtype=np.int64)),
                "n_texts": pa.array([n for _, n in found.values()], pa.int64())})
            found.clear()
            return out

        for batch in batches:
            present = slot_counts(batch.column("tokens"), width) > 0
            kbs = batch.column("kb_id").dictionary_encode()
            codes = kbs.indices.to_numpy(zero_copy_only=False)
            for code, kb in enumerate(kbs.dictionary.to_pylist()):
                mine = present[codes == code]
                df, n = found.get(kb, (0, 0))
                found[kb] = (df + mine.sum(axis=0), n + len(mine))
            if len(found) > held_kbs:
                yield flush()
        if found:
            yield flush()

    return run


def _to_slots(matrix: np.ndarray) -> pa.Array:
    """(slot, weight) of what is not zero in each row."""
    row, slot = np.nonzero(matrix)
    offsets = np.searchsorted(row, np.arange(len(matrix) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(slot.astype(np.int32)), pa.array(matrix[row, slot])], ["slot", "weight"]))


def weighted_slots(kb: Column, tokens: Column, sent: Broadcast, width: int = VECTOR_WIDTH,
                   sparse: bool = False) -> Column:
    """Token counts per slot times the kb's slot weights, scaled to length one, as float32.

    ``sent`` maps kb_id to its weights. A text of another kb gets null. ``sparse`` gives slots
    with their weights, only those that are not zero.
    """

    @F.arrow_udf("array<struct<slot:int,weight:float>>" if sparse else "array<float>")
    def vectors(kbs: pa.Array, lists: pa.Array) -> pa.Array:
        held = sent.value
        coded = kbs.dictionary_encode()
        names = coded.dictionary.to_pylist()
        table = np.array([held.get(name, np.zeros(width)) for name in names]).reshape(-1, width)
        known = np.array([name in held for name in names], dtype=bool)
        at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        raw = slot_counts(lists, width)
        if len(names):
            raw = raw * table[at]
        good = (at >= 0) & (known[at] if len(names) else False)
        rows = (_to_slots if sparse else _to_lists)(unit_rows(raw).astype(np.float32))
        return rows if good.all() else rows.take(pa.array(np.arange(len(at)), mask=~good))

    return vectors(kb, tokens)


def _tokens(texts: DataFrame, content: str) -> Column:
    return F.col("tokens") if "tokens" in texts.columns else tokenize(F.col(content))


def slot_weights(texts: DataFrame, content: str = "content",
                 width: int = VECTOR_WIDTH) -> DataFrame:
    """(kb_id, slot_idf): inverse document frequency of every slot, one array per kb.

    Frequencies are kept per slot, so there are ``width`` numbers per kb however large the
    vocabulary grows, and each task hands on only its own sums per kb.
    """
    counted = texts.select("kb_id", _tokens(texts, content).alias("tokens")).mapInArrow(
        _slot_frequencies(width), "kb_id string, dfs array<bigint>, n_texts bigint")
    slots = counted.select("kb_id", "n_texts", F.posexplode("dfs").alias("slot", "df"))
    per_slot = slots.groupBy("kb_id", "slot").agg(
        F.sum("df").alias("df"), F.sum("n_texts").alias("n_texts"))
    return weigh_slots(per_slot)


def weigh_slots(per_slot: DataFrame) -> DataFrame:
    """(kb_id, slot_idf) from (kb_id, slot, df, n_texts), a row for each slot of a kb."""
    idf = F.log((F.col("n_texts") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return per_slot.groupBy("kb_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", idf.alias("idf")))),
        lambda s: s["idf"]).alias("slot_idf"))


def slot_table(weights: DataFrame, width: int = VECTOR_WIDTH) -> dict[str, np.ndarray]:
    """Slot weights by kb, which the caller knows to be few enough for one block."""
    table = weights.select("kb_id", "slot_idf").toArrow()
    return dict(zip(table.column("kb_id").to_pylist(), matrix_of(
        table.column("slot_idf").combine_chunks(), width) if table.num_rows else []))


def vectorize(texts: DataFrame, weights: DataFrame, content: str = "content",
              width: int = VECTOR_WIDTH, block_bytes: int = BLOCK_BYTES, sparse: bool = False) -> DataFrame:
    """Add ``embedding``: unit-length hashed TF-IDF, float32. Texts without tokens get zeros.
    With ``sparse`` it has the slots and weights that are not zero.

    Input order and duplicates are kept as rows; texts of a kb without weights are dropped.
    Weights go to the tasks once, not with every row: their size is checked, and more kbs than one
    block holds are sent in further blocks, each with a pass over its own kbs' texts.
    """
    spark = texts.sparkSession
    n_blocks = max(1, -(-weights.count() * (width * 8 + 64) // block_bytes))
    block_of = F.pmod(F.xxhash64("kb_id"), F.lit(n_blocks))
    parts = []
    for i in range(n_blocks):
        sent = spark.sparkContext.broadcast(slot_table(weights.filter(block_of == i), width))
        parts.append(texts.filter(block_of == i).withColumn(
            "embedding", weighted_slots(F.col("kb_id"), _tokens(texts, content), sent, width, sparse)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.filter(F.col("embedding").isNotNull())


def pack_vectors(table: pa.Table) -> dict:
    out = {}
    kbs = np.array(table.column("kb_id").to_pylist(), dtype=object)
    ids = table.column("query_id").to_pylist()
    vectors = table.column("embedding").combine_chunks()
    for kb in set(kbs):
        at = np.nonzero(kbs == kb)[0]
        lists = vectors.take(pa.array(at))
        width = len(lists[0])
        out[kb] = {"ids": [ids[i] for i in at], "width": width,
                   "matrix": unit_rows(matrix_of(lists, width)).T.copy()}
        if "probes" in table.column_names:
            out[kb]["probes"] = [table.column("probes")[int(i)].as_py() for i in at]
    return out


def _score_vectors(entry: dict, kb: str, batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple]:
    vectors = batch.column("embedding").take(pa.array(rows))
    normal = unit_rows(matrix_of(vectors, entry["width"]))
    probed = None
    if "probes" in entry:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)[rows].astype(int)
        table = np.zeros((entry["n_cells"], len(entry["ids"])), dtype=bool)
        for q, wanted in enumerate(entry["probes"]):
            table[wanted, q] = True
        probed = table[cells]
    for part in row_slices(len(rows), len(entry["ids"])):
        yield part, normal[part] @ entry["matrix"], None if probed is None else probed[part]


def dense_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "chunk_id",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact nearest rows by cosine within the question's kb: query_id, row id, score, rank.

    ``rows``: kb_id, row id, embedding. ``queries``: query_id, kb_id, embedding.
    """
    slim = rows.select("kb_id", F.col(row_id).cast("string").alias("row_id"), "embedding")
    found = scan_top_k(
        slim, queries.select("query_id", "kb_id", "embedding"),
        F.size("embedding") * 8 + 64, k, pack_vectors, _score_vectors, block_bytes)
    return found.withColumnRenamed("row_id", row_id)


#: Every vector is compared with every centre once, and the centres go to all tasks (8 MB for 64
#: numbers each), so their number stops growing here; cells get larger, and are spread over tasks.
MAX_CELLS = 16_384
#: Centres are trained on so many vectors at most; every vector is indexed.
TRAINED_ON = 200_000
ROUNDS = 8
#: Share of the true neighbours that a search is meant to find.
RECALL = 0.9
#: A search goes on until it expects to miss this share of what it may.
CAUTION = 0.5
_LEVELS = 8


def _mean_directions(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres moved to the mean of the vectors nearest to them; one without any stays."""
    near = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(
        vectors, 1 + len(vectors) * len(centres) // 20_000_000)])
    order = np.argsort(near, kind="stable")
    held, first = np.unique(near[order], return_index=True)
    moved = centres.copy()
    moved[held] = unit_rows(np.add.reduceat(vectors[order], first, axis=0))
    return moved


class CellIndex:
    """Inverted file: vectors grouped into cells around trained centres, questions probe some.

    Centres start from the vectors with the least MD5 of their id, about the root of the number
    of rows, at most MAX_CELLS, and are trained by spherical k-means on a sample of TRAINED_ON
    vectors. A vector belongs to the centre of largest cosine. Rows are stored sorted by cell,
    so cells nobody probes are skipped, and a hot cell is spread over tasks by row id.

    A search looks at each question's nearest cells, takes the k-th score there, and asks how
    many members of each other cell may beat it: a member's cosine with the question is that of
    two steps, question to centre and centre to member, at an angle between them which is nearly
    normal, with a spread that the sample tells. Cells are probed in order of that number until
    what is left is expected to hold less than half of the neighbours that may be missed.
    """

    def __init__(self, rows: DataFrame, row_id: str = "chunk_id", n_cells: int | None = None):
        count = rows.count()
        wanted = n_cells or min(MAX_CELLS, max(1, math.ceil(math.sqrt(count))))
        key = F.col(row_id).cast("string")
        sample = rows.orderBy(F.md5(key), key).limit(TRAINED_ON).select(
            F.md5(key).alias("turn"), key.alias("id"), "embedding").toArrow().sort_by(
            [("turn", "ascending"), ("id", "ascending")])
        lists = sample.column("embedding").combine_chunks()
        vectors = unit_rows(matrix_of(lists, len(lists[0]))) if len(lists) else np.zeros((0, 0))
        self.centres = vectors[:wanted].copy()
        for _ in range(ROUNDS if len(vectors) > wanted else 0):
            self.centres = _mean_directions(vectors, self.centres)
        self.spread = self._spread(vectors)
        placed = rows.withColumn("_near", self._nearest(F.col("embedding"))).withColumn(
            "cell", F.col("_near.cell")).withColumn("_cosine", F.col("_near.cosine")).drop("_near")
        self.rows = materialize(
            placed.repartitionByRange("cell", row_id).sortWithinPartitions("cell"), "cells")
        levels = [(i + 0.5) / _LEVELS for i in range(_LEVELS)]
        held = self.rows.groupBy("cell").agg(
            F.count("*").alias("n"), F.percentile_approx("_cosine", levels, 1000).alias("cosines")).toArrow()
        self.sizes = np.zeros(len(self.centres))
        self.cosines = np.ones((len(self.centres), _LEVELS))
        at = held.column("cell").to_numpy()
        self.sizes[at] = held.column("n").to_numpy()
        self.cosines[at] = np.array(held.column("cosines").to_pylist(), float).reshape(-1, _LEVELS)

    def _spread(self, vectors: np.ndarray) -> float:
        """How far the directions from centres to members are from right angles with each other."""
        if len(vectors) < 2:
            return 1.0
        some = vectors[:20_000]
        near = np.argmax(some @ self.centres.T, axis=1)
        step = some - np.sum(some * self.centres[near], axis=1)[:, None] * self.centres[near]
        step = unit_rows(step[np.linalg.norm(step, axis=1) > 1e-9])
        if len(step) < 2:
            return 1.0
        return float(np.sqrt(np.mean(np.sum(step * np.roll(step, 1, axis=0), axis=1) ** 2)))

    def _nearest(self, vectors: Column) -> Column:
        """The cell of largest cosine, equal ones by number, and that cosine."""
        centres = self.centres

        @F.arrow_udf("struct<cell: int, cosine: double>")
        def nearest(lists: pa.Array) -> pa.Array:
            if not len(lists):
                return pa.array([], pa.struct([("cell", pa.int32()), ("cosine", pa.float64())]))
            found = unit_rows(matrix_of(lists, centres.shape[1])) @ centres.T
            cell = np.argmax(np.round(found, 9), axis=1)
            return pa.StructArray.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(found[np.arange(len(cell)), cell])], names=["cell", "cosine"])

        return nearest(vectors)

    def _closest(self, n: int) -> Column:
        """The ``n`` cells whose centres lie closest to the embedding."""
        centres = self.centres

        @F.arrow_udf("array<int>")
        def closest(lists: pa.Array) -> pa.Array:
            found = [] if not len(lists) else np.argsort(
                -np.round(unit_rows(matrix_of(lists, centres.shape[1])) @ centres.T, 9), axis=1, kind="stable")[:, :n].tolist()
            return pa.array(found, pa.list_(pa.int32()))

        return closest(F.col("embedding"))

    def expected(self, questions: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Questions x cells: how many members of a cell are expected to score ``kth`` or more."""
        to_centre = np.clip(questions @ self.centres.T, -1, 1)[:, :, None]
        across = np.sqrt(1 - to_centre ** 2) * np.sqrt(np.maximum(0, 1 - self.cosines ** 2))[None]
        lacks = (kth[:, None, None] - to_centre * self.cosines[None]) / np.maximum(1e-9, across * self.spread)
        z = np.clip(lacks, -8, 8)
        # The normal curve's tail, by a hyperbolic tangent.
        tail = 0.5 - 0.5 * np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z ** 3))
        return (self.sizes / _LEVELS)[None] * np.sum(tail, axis=2)

    def probes(self, questions: np.ndarray, kth: np.ndarray, k: int, recall: float) -> list[np.ndarray]:
        """Cells of each question in order, until no more is expected in the others than allowed."""
        allowed = CAUTION * (1 - recall) * k
        out = []
        for part in np.array_split(np.arange(len(questions)), 1 + len(questions) * len(self.centres) // 500_000):
            hopes = self.expected(questions[part], kth[part])
            for hope in hopes:
                order = np.argsort(-hope, kind="stable")
                left = hope.sum() - np.cumsum(hope[order])
                out.append(np.sort(order[:int(np.argmax(left <= allowed)) + 1]))
        return out

    def _with_probes(self, queries: DataFrame, k: int, recall: float) -> DataFrame:
        """Add ``probes``: the cells to look at, by the question's ``kth`` score; without one, the
        nearest cells that hold ``4 k`` vectors."""
        index = self._light()

        @F.arrow_udf("array<int>")
        def choose(lists: pa.Array, kth: pa.Array) -> pa.Array:
            kind = pa.list_(pa.int32())
            if not len(lists):
                return pa.array([], kind)
            asked = unit_rows(matrix_of(lists, index.centres.shape[1]))
            known = kth.to_numpy(zero_copy_only=False).astype(float)
            cells: list = []
            for question, score in zip(asked, known):
                if np.isnan(score):
                    order = np.argsort(-(index.centres @ question), kind="stable")
                    enough = np.searchsorted(np.cumsum(index.sizes[order]), 4 * k) + 1
                    cells.append(order[:enough])
                else:
                    cells += index.probes(question[None], np.array([score]), k, recall)
            return pa.array([c.astype(np.int32).tolist() for c in cells], kind)

        return queries.withColumn("probes", choose(F.col("embedding"), F.col("kth")))

    def _light(self) -> CellIndex:
        """The numbers alone, to be sent to tasks."""
        light = object.__new__(CellIndex)
        light.centres, light.sizes, light.cosines, light.spread = self.centres, self.sizes, self.cosines, self.spread
        return light

    def top_k(self, queries: DataFrame, k: int = 5, n_probes: int | None = None, row_id: str = "chunk_id",
              block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> DataFrame:
        """Like :func:`dense_top_k`, with ``recall`` of the true neighbours expected.

        Two searches: the nearest cells, which give a k-th score, then the cells that this asks
        for. With ``n_probes`` so many nearest cells are searched instead, whatever that finds.
        """
        asked = queries.select("query_id", "kb_id", "embedding")
        if n_probes:
            return self._search(asked.withColumn("probes", self._closest(n_probes)), k, row_id, block_bytes)
        none = F.lit(None).cast("double")
        first = materialize(self._search(self._with_probes(asked.withColumn("kth", none), k, recall), k, row_id,
                                         block_bytes), "first-cells")
        kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        # A question with fewer hits than k looks everywhere.
        told = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        return self._search(self._with_probes(told, k, recall), k, row_id, block_bytes)

    def _search(self, asked: DataFrame, k: int, row_id: str, block_bytes: int) -> DataFrame:
        n_cells = len(self.centres)

        def pack(table: pa.Table) -> dict:
            packed = pack_vectors(table)
            for entry in packed.values():
                entry["n_cells"] = n_cells
            return packed

        asked = materialize(asked.select("query_id", "kb_id", "embedding", "probes"), "probes")
        # At most MAX_CELLS numbers.
        probed = [r[0] for r in asked.select(F.explode("probes")).distinct().collect()]
        slim = self.rows.filter(F.col("cell").isin(*probed)).select(
            "kb_id", F.col(row_id).cast("string").alias("row_id"), "embedding", "cell")
        found = scan_top_k(slim, asked, F.size("embedding") * 8 + F.size("probes") * 4 + 128, k, pack,
                           _score_vectors, block_bytes)
        return found.withColumnRenamed("row_id", row_id)


def width_report(kbs: DataFrame, rows: DataFrame, expected: int) -> DataFrame:
    """Per kb: smallest and largest vector width and whether all equal ``expected``.

    A kb without vectors is compatible.
    """
    widths = rows.groupBy("kb_id").agg(
        F.min(F.size("embedding")).alias("min_width"),
        F.max(F.size("embedding")).alias("max_width"))
    fits = (F.col("min_width") == expected) & (F.col("max_width") == expected)
    return kbs.select("kb_id").join(widths, "kb_id", "left").withColumn(
        "compatible", F.coalesce(fits, F.lit(True)))
