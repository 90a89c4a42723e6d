"""Split text blocks into overlapping chunks that end at sentence boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Default window, boundary marks in order of preference, look-back distance.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
BOUNDARY_MARKS = ("\n\n", "\n", "。", "；", "，", ".", ";", ",")
LOOK_BACK = 100
#: Texts of one Arrow batch are taken as strings so many bytes at a time.
SLICE_BYTES = 1 << 20

# A mark's first character, followed by the rest of it: overlapping places count, as in "\n\n\n".
_MARK_PATTERNS = [re.compile(re.escape(mark[0]) + (f"(?={re.escape(mark[1:])})" if mark[1:] else ""))
                  for mark in BOUNDARY_MARKS]


def check_window(size: int, overlap: int) -> None:
    """Refuse windows that might not move forward."""
    if size < 1 or overlap < 0 or max(1, size - LOOK_BACK + 1) <= overlap:
        raise ValueError(f"chunk size {size} with overlap {overlap} cannot make progress")


class _Marks:
    """Where each mark stands in a text, found when first asked for, so that a cut is a few
    binary searches and marks that never decide are never looked up."""

    def __init__(self, text: str):
        self.text = text
        self.places: list[list[int] | None] = [None if mark in text else [] for mark in BOUNDARY_MARKS]

    def of(self, kind: int) -> list[int]:
        found = self.places[kind]
        if found is None:
            found = self.places[kind] = [m.start() for m in _MARK_PATTERNS[kind].finditer(self.text)]
        return found

    def cut_before(self, low: int, high: int) -> int:
        """End of the last preferred mark lying wholly in [low, high), or ``high``."""
        for kind, mark in enumerate(BOUNDARY_MARKS):
            places, last = self.of(kind), high - len(mark)
            at = bisect_right(places, last) - 1
            if at >= 0 and places[at] >= low:
                return places[at] + len(mark)
        return high


def windows(text: str, size: int, overlap: int, drop_contained_tail: bool,
            marks: _Marks | None = None) -> list[str]:
    """Chunks of one text: bounds of all windows first, then their stripped texts.

    A window that does not reach the end stops at the best mark of its last LOOK_BACK
    characters, where the first kind of mark found there wins over closer ones. A text that
    fits one window is kept as it is.
    """
    n = len(text)
    if n <= size:
        return [text] if text.strip() else []
    marks = marks or _Marks(text)
    begins, ends = [0], []
    while True:
        full = begins[-1] + size
        ends.append(full if full >= n else marks.cut_before(
            max(begins[-1], full - LOOK_BACK), full))
        following = ends[-1] - overlap
        if following >= n or drop_contained_tail and ends[-1] >= n:
            break
        begins.append(following)
    pieces = (text[a:b].strip() for a, b in zip(begins, ends))
    return [piece for piece in pieces if piece]


def split_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               drop_contained_tail: bool = False) -> Column:
    """Array of chunks of a text column."""
    return F.get(split_all(text, [(size, overlap)], drop_contained_tail), F.lit(0))


def split_all(text: Column, settings: list[tuple[int, int]], drop_contained_tail: bool = False) -> Column:
    """Arrays of chunks of a text column, one for each (size, overlap).

    Where a chunk starts depends on where the last one was cut, so this is a small Arrow
    function per text rather than an expression; Spark spreads the texts. Marks are looked up
    once for all settings.
    """
    for size, overlap in settings:
        check_window(size, overlap)
    kind = pa.list_(pa.list_(pa.string()))

    def parts_of(t: str) -> list[list[str]]:
        marks = _Marks(t)
        return [windows(t, size, overlap, drop_contained_tail, marks) for size, overlap in settings]

    @F.arrow_udf("array<array<string>>")
    def parts(texts: pa.Array) -> pa.Array:
        return _concat([pa.array([None if t is None else parts_of(t) for t in some.to_pylist()], type=kind)
                        for some in byte_slices(texts)], kind)

    return parts(text)


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive texts of about ``size`` bytes, at least one, so that a task's strings stay few."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    turn = np.cumsum(lengths, dtype=np.int64) // size
    starts = np.nonzero(np.diff(turn, prepend=-1))[0].tolist()
    for start, stop in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(start, stop - start)


def _concat(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def chunk_blocks(blocks: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 drop_contained_tail: bool = False) -> DataFrame:
    """One row per chunk; ``chunk_index`` starts over in every block.

    ``blocks``: kb_id, doc_id, text, page, source, type, image. ``chunk_id`` is unique as
    long as (kb_id, doc_id, page) names one block; ``chunk_label`` is the short form for display.
    """
    kept = ("kb_id", "doc_id", "page", "source", "type", "image")
    split = blocks.select(
        *kept, split_text(F.col("text"), size, overlap, drop_contained_tail).alias("parts"))
    exploded = split.select(
        *kept, F.posexplode("parts").alias("chunk_index", "content")
    ).withColumn("type", F.coalesce("type", F.lit("text")))
    return exploded.select(
        "kb_id", "doc_id",
        F.concat_ws("#", F.col("kb_id"), F.col("doc_id").cast("string"),
                    F.coalesce(F.col("page"), F.lit(0)).cast("string"),
                    F.col("chunk_index").cast("string")).alias("chunk_id"),
        chunk_label().alias("chunk_label"),
        "chunk_index", "content", "page", "source", "type", "image",
    )


def chunk_label() -> Column:
    """``{source}_chunk{index}``: readable, but shared by the pages of one source."""
    return F.concat(F.col("source"), F.lit("_chunk"), F.col("chunk_index").cast("string"))


def sweep_windows(blocks: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """Chunk the same blocks under several (size, overlap) pairs.

    All settings share one pass: each block crosses to Python once and only then fans out to rows.
    """
    named = F.transform(F.col("_parts"), lambda parts, i: F.struct(
        F.get(F.array(*[F.lit(size) for size, _ in settings]), i).alias("chunk_size"),
        F.get(F.array(*[F.lit(overlap) for _, overlap in settings]), i).alias("overlap"),
        parts.alias("parts")))
    wide = blocks.select("kb_id", "doc_id", split_all(F.col("text"), settings).alias("_parts"))
    return (
        wide.select("kb_id", "doc_id", F.explode(named).alias("s"))
        .select("kb_id", "doc_id", "s.chunk_size", "s.overlap",
                F.posexplode("s.parts").alias("chunk_index", "content"))
    )
