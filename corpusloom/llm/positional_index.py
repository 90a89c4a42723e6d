"""Benchmark decontamination with a positional inverted index over the training documents.

1. Every task turns its texts into *shards* of a few megabytes: for each term of the shard the
   sorted positions of all its occurrences. A shard is one row of a stored table, so a term that
   fills a third of the corpus is spread over all shards and nothing is shuffled. Terms are dealt
   into buckets by hash, a group of columns each: a search reads the buckets its terms are in.
2. Test items go to the shards in blocks of bounded size. The index first tells how often each
   of a block's terms occurs in the whole corpus.
3. A window of an item starts from the postings of its rarest term, moved back by the term's
   place in the window; the lists of the other terms, rarest first, are moved likewise and
   intersected. What is left are exact phrases. With postings looked for on both sides of the
   rarest term instead, the same lists give matches by proximity.

Terms are compared by 64-bit hashes. A phrase is found wrongly only if all its terms but those
that agree collide; among a billion different terms and ten thousand of the tests', one pair
does so with a probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType,
                               StructField, StructType)

from corpusloom.llm.common import list_array, small_slices, string_buffers, word_hashes
from corpusloom.session import materialize

#: Bytes that are no part of a word, x00-2F, 3A-60 but for capitals, 7B-7F.
BREAKS = np.zeros(256, bool)
BREAKS[0x00:0x30] = BREAKS[0x3A:0x41] = BREAKS[0x5B:0x61] = BREAKS[0x7B:0x80] = True

WINDOW = 10
#: A proximity match has every word of a window at most so many words from its rarest one.
REACH = 12
BUCKET_BITS = 4
SHARD_BYTES = 4 << 20
#: Words of test items in a block, some 10 MB as sent to a task.
BLOCK_WORDS = 200_000
#: Postings of rarest terms that a task expands at once.
STEP_POSTINGS = 1 << 20

_BUCKETS = range(1 << BUCKET_BITS)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start .. start + count of every row, one after the other."""
    total = int(counts.sum())
    before = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - before + np.repeat(starts, counts)


def _shards(out: pa.Schema):
    """mapInArrow: (id, text) to one row per run of texts, see ``build_index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in small_slices(batch, size=SHARD_BYTES):
                starts, body = string_buffers(rows.column(1))
                owner, terms = word_hashes(body, starts, BREAKS)
                words = np.bincount(owner, minlength=len(rows))
                position = np.arange(len(terms)) + owner  # one free place behind each text
                order = np.argsort(terms, kind="stable")
                terms, position = terms[order], position[order]
                fresh = np.ones(len(terms), bool)
                fresh[1:] = terms[1:] != terms[:-1]
                gaps = np.diff(position, prepend=0)
                gaps[fresh] = position[fresh]
                first = np.nonzero(fresh)[0]
                counts = np.diff(np.append(first, len(terms)))
                distinct = terms[first]
                edges = np.searchsorted(distinct >> np.uint64(64 - BUCKET_BITS),
                                        np.arange(len(_BUCKETS) + 1, dtype=np.uint64))
                token_edges = np.append(first, len(terms))[edges]
                cells = []
                for b in _BUCKETS:
                    of, tokens = slice(edges[b], edges[b + 1]), slice(token_edges[b], token_edges[b + 1])
                    for part in (distinct[of].astype("<u8"), counts[of].astype("<u4"),
                                 gaps[tokens].astype("<u4")):
                        cells.append(pa.array([part.tobytes()], pa.binary()))
                whole = np.array([0, len(rows)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), list_array(rows.column(0), whole),
                    list_array(pa.array(words.astype(np.int32)), whole), *cells], schema=out)
                shard += 1

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row per shard with shard, ids, words (a number per text) and, for each
    bucket b of terms, t<b> (sorted hashes), c<b> (occurrences of each) and g<b> (positions, as
    gaps within a term). Null texts have no words; other columns are not looked at.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([
        StructField("shard", LongType()), StructField("ids", ArrayType(whole.schema["id"].dataType)),
        StructField("words", ArrayType(IntegerType())),
        *(StructField(f"{x}{b}", BinaryType()) for b in _BUCKETS for x in "tcg")])
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    return materialize(whole.mapInArrow(_shards(arrow), schema), "positional-index")


@dataclass
class Queries:
    """Windows of a block of items. ``terms`` and ``places`` have a row per window, with the terms'
    numbers in ``hashes`` and their places in the window, -1 as terms where it is shorter."""

    hashes: np.ndarray
    terms: np.ndarray
    places: np.ndarray
    items: list[str]
    bounds: np.ndarray  # items of window i: item_of[bounds[i]:bounds[i + 1]]
    item_of: np.ndarray

    @property
    def buckets(self) -> list[int]:
        return np.unique(self.hashes >> np.uint64(64 - BUCKET_BITS)).astype(int).tolist()

    def rarest_first(self, frequency: np.ndarray) -> None:
        rank = np.where(self.terms < 0, np.iinfo(np.int64).max, frequency[self.terms])
        order = np.argsort(rank, axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms, order, 1)
        self.places = np.take_along_axis(self.places, order, 1)


def windows_of(items: list[str], texts: list[str]) -> Queries | None:
    """All different windows of the texts; None if there is none."""
    starts, body = string_buffers(pa.array(texts, pa.string()))
    owner, words = word_hashes(body, starts, BREAKS)
    if not len(words):
        return None
    hashes, code = np.unique(words, return_inverse=True)
    counts = np.bincount(owner, minlength=len(items))
    first = np.cumsum(counts) - counts
    size = np.minimum(counts, WINDOW)
    begin = _ragged(first, np.where(counts > 0, counts - size + 1, 0))
    item = owner[begin]
    places = np.tile(np.arange(WINDOW, dtype=np.int32), (len(begin), 1))
    inside = places < size[item][:, None]
    terms = np.where(inside, code[np.minimum(begin[:, None] + places, len(code) - 1)], -1)
    terms, window = np.unique(terms.astype(np.int32), axis=0, return_inverse=True)
    names, name = np.unique(np.array(items, dtype=object), return_inverse=True)
    pairs = np.unique(np.column_stack([window.ravel(), name.ravel()[item]]), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    return Queries(hashes, terms, np.tile(np.arange(WINDOW, dtype=np.int32), (len(terms), 1)),
                   names.tolist(), bounds, pairs[:, 1])


def _column(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def _found(batch: pa.RecordBatch, row: int, hashes: np.ndarray, bucket: int):
    """(numbers of the hashes that the shard's bucket has, their places in it, its counts)."""
    have = _column(batch, f"t{bucket}", row, "<u8")
    lo, hi = np.searchsorted(hashes >> np.uint64(64 - BUCKET_BITS),
                             np.array([bucket, bucket + 1], np.uint64))
    at = np.searchsorted(have, hashes[lo:hi])
    here = np.nonzero(at < len(have))[0]
    here = here[have[at[here]] == hashes[lo:hi][here]]
    return here + lo, at[here], _column(batch, f"c{bucket}", row, "<u4").astype(np.int64)


def _frequencies(query: Queries, out: pa.Schema):
    hashes, buckets = query.hashes, query.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for b in buckets:
                    term, at, counts = _found(batch, row, hashes, b)
                    total[term] += counts[at]
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], schema=out)

    return run


def _postings(batch: pa.RecordBatch, row: int, query: Queries, buckets: list[int]):
    """(sorted keys term << 32 | position of the shard, occurrences of each term)."""
    keys, total = [], np.zeros(len(query.hashes), np.int64)
    for b in buckets:
        term, at, counts = _found(batch, row, query.hashes, b)
        if len(term):
            gaps = _column(batch, f"g{b}", row, "<u4")
            n = counts[at]
            total[term] = n
            steps = gaps[_ragged((np.cumsum(counts) - counts)[at], n)].astype(np.int64)
            sums = np.cumsum(steps)
            before = np.cumsum(n) - n
            position = sums - np.repeat(sums[before] - steps[before], n)
            keys.append(np.repeat(term, n) << 32 | position)
    return np.concatenate(keys) if keys else np.zeros(0, np.int64), total


def _at_least(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least key from each wanted one up; -1 behind the last."""
    at = np.searchsorted(keys, wanted)
    return np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], -1)


def search_shard(keys: np.ndarray, total: np.ndarray, terms: np.ndarray, places: np.ndarray,
                 window: np.ndarray, bases: np.ndarray, reach: int | None):
    """(windows, positions, exact): starts of phrases, then places of the rarest term that all
    others are within ``reach`` of, for the windows whose terms the shard all has."""
    first = np.searchsorted(keys, terms[window, 0].astype(np.int64) << 32)
    n = total[terms[window, 0]]
    anchor = keys[_ragged(first, n)] & 0xFFFFFFFF
    of = np.repeat(window, n)
    found = []
    start, mine = anchor - places[of, 0], of
    for j in range(1, terms.shape[1]):
        term = terms[mine, j].astype(np.int64)
        key = term << 32 | np.maximum(0, start + places[mine, j])
        ok = (term < 0) | (_at_least(keys, key) == key)
        start, mine = start[ok], mine[ok]
    found.append((mine, start, np.ones(len(mine), bool)))
    if reach is not None:
        row = np.searchsorted(bases, anchor, side="right") - 1
        low, high = np.maximum(anchor - reach, bases[row]), np.minimum(anchor + reach, bases[row + 1] - 1)
        spot, mine = anchor, of
        for j in range(1, terms.shape[1]):
            term = terms[mine, j].astype(np.int64)
            near = _at_least(keys, term << 32 | low)
            ok = (term < 0) | ((near >= 0) & (near <= (term << 32 | high)))
            spot, mine, low, high = spot[ok], mine[ok], low[ok], high[ok]
        found.append((mine, spot, np.zeros(len(mine), bool)))
    return [np.concatenate(x) for x in zip(*found)]


def _matches(query: Queries, reach: int | None, out: pa.Schema):
    """mapInArrow: shards to a row per text with matches."""
    buckets = query.buckets
    length = (query.terms >= 0).sum(1)

    def items_of(texts: np.ndarray, windows: np.ndarray, rows: np.ndarray) -> pa.ListArray:
        """Names of the items of each row's windows, each once."""
        n = np.diff(query.bounds)[windows]
        pairs = np.unique(np.column_stack([
            np.repeat(texts, n), query.item_of[_ragged(query.bounds[windows], n)]]), axis=0)
        names = pa.array(query.items, pa.string()).take(pa.array(pairs[:, 1]))
        return list_array(names, np.searchsorted(pairs[:, 0], np.append(rows, rows[-1] + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, total = _postings(batch, i, query, buckets)
                if not len(keys):
                    continue
                words = batch.column("words")[i].values.to_numpy().astype(np.int64)
                bases = np.concatenate([[0], np.cumsum(words + 1)])
                all_here = ((total[query.terms] > 0) | (query.terms < 0)).all(1)
                windows = np.nonzero(all_here)[0]
                load = np.cumsum(total[query.terms[windows, 0]])
                found = [search_shard(keys, total, query.terms, query.places, part, bases, reach)
                         for part in np.split(windows, np.nonzero(np.diff(load // STEP_POSTINGS))[0] + 1)
                         if len(part)]
                if not found:
                    continue
                window, position, exact = (np.concatenate(x) for x in zip(*found))
                if not len(window):
                    continue
                text = np.searchsorted(bases, position, side="right") - 1
                rows = np.unique(text)
                hit = np.nonzero(exact)[0]
                hit = hit[np.lexsort((position[hit], text[hit]))]
                spans = pa.StructArray.from_arrays(
                    [pa.array(position[hit] - bases[text[hit]]),
                     pa.array(position[hit] - bases[text[hit]] + length[window[hit]])],
                    names=["start", "end"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), batch.column("shard")[i].as_py(), np.int64)),
                    pa.array(rows.astype(np.int32)),
                    list_array(spans, np.searchsorted(text[hit], np.append(rows, rows[-1] + 1))),
                    items_of(text[exact], window[exact], rows),
                    items_of(text, window, rows)], schema=out)

    return run


def phrase_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id",
                   text_col: str = "text", *, reach: int | None = REACH) -> DataFrame:
    """Texts with matches: shard, row, spans (start, end in words), items, near.

    ``items`` are those with a window of WINDOW words in the text (of all its words, if there
    are fewer), ``near`` those with a window whose words all occur at most ``reach`` words from
    an occurrence of its rarest word in the corpus, or in the same text as a phrase; without
    ``reach`` only phrases are looked for. A text in which several blocks of items match has a row for each.
    Rows of ``items`` that repeat an id are one item; a row without an id goes by the empty
    name. Null texts and texts without words match nothing.
    """
    spark = index.sparkSession
    asked = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.length("text") / 2 + 1  # no text has more
    total = asked.agg(F.sum(words)).first()[0] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([
        StructField("shard", LongType()), StructField("row", IntegerType()),
        StructField("spans", ArrayType(span)), StructField("items", ArrayType(StringType())),
        StructField("near", ArrayType(StringType()))])
    counted = StructType([StructField("term", LongType()), StructField("n", LongType())])

    def arrow(kind: StructType) -> pa.Schema:
        return spark.createDataFrame([], kind).toArrow().schema

    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        # About BLOCK_WORDS words at a time; the items are a query set, not the corpus.
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().toArrow()
        query = windows_of(part.column("item").to_pylist(), part.column("text").to_pylist())
        if query is None:
            continue
        counts = index.select("shard", *(f"{x}{b}" for b in query.buckets for x in "tc")).mapInArrow(
            _frequencies(query, arrow(counted)), counted).groupBy("term").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(query.hashes), np.int64)
        for row in counts.collect():  # at most the block's different words
            frequency[row.term] = row.n
        query.rarest_first(frequency)
        found = found.union(index.select(
            "shard", "words", *(f"{x}{b}" for b in query.buckets for x in "tcg")).mapInArrow(
            _matches(query, reach, arrow(schema)), schema))
    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. A window
    is WINDOW consecutive words of an item, or all of a shorter item that has words; words of a
    document inside an occurrence of a window are hit. n_items counts the items with such
    windows, items_sha256 is of their ids as sorted strings joined by commas, n_near counts items
    by proximity as in ``phrase_matches``. Rows that repeat an id are judged each by its own
    text, and so are rows without one; null texts have no words. Columns of other names are not
    looked at; without documents the result is empty, without items nothing is hit.
    """
    index = build_index(docs, id_col, text_col)
    texts = index.select("shard", F.posexplode(F.arrays_zip("ids", "words")).alias("row", "of")).select(
        "shard", "row", F.col("of.ids").alias("id"), F.col("of.words").cast("long").alias("n_words"))
    # A text's matches of several blocks of items come together: as many as it has words and items.
    found = phrase_matches(index, items).groupBy("shard", "row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("near")))).cast("long").alias("n_near"))
    zero = F.lit(0).cast("long")
    hit = F.aggregate("spans", F.struct(zero.alias("hit"), zero.alias("upto")), lambda a, s: F.struct(
        (a["hit"] + F.greatest(zero, s["end"] - F.greatest(s["start"], a["upto"]))).alias("hit"),
        F.greatest(s["end"], a["upto"]).alias("upto")))["hit"]
    found = found.select("shard", "row", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "n_near")
    n_hit = F.coalesce("n_hit", zero)
    return texts.join(found, ["shard", "row"], "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"))
