"""Near duplicates by SetSketch registers.

1. Texts with equal sets of shingles form a class; only one row per class goes on, under a
   number, and ids come back at the end.
2. A class's sketch has 128 registers. Register i is floor(1 - log_b(x)) for the least of the
   set's exponential variates h_i, cut to 16 bits: exponentially spaced truncated minima.
   Sketches of parts merge by the larger register, and registers of two sets agree about as
   often as the sets overlap, for a base this near to 1.
3. Bands of four registers each are hashed. At a similarity of 0.8 all 32 bands of a pair
   differ with a probability of (1 - 0.8**4)**32, below 1e-7.
4. Members of a band's bucket are paired with its least member only, so a bucket of thousands
   makes thousands of pairs. A pair goes on unless its registers are far less likely at any
   similarity from the threshold up than at some one below it (a joint likelihood of both
   sketches and both set sizes). Whole sets decide.
5. Links found join into components. Buckets that still hold several components are gone
   through again for pairs across components, on whole sets, in blocks of bounded size; of
   buckets with the same members one is enough. Only links that join two components come out, fewer than a bucket has rows, and none that would
   join two is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StructField, StructType)

from corpusloom.llm.common import forget_kept, list_array, mix64, partitions_for, possibly_in, shingle_sets
from corpusloom.llm.components import connected_components
from corpusloom.session import materialize

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
#: A pair is dropped when no similarity from the threshold up comes nearer than this to the
#: best log likelihood: six standard deviations.
MARGIN = 18.0
#: Buckets of up to this many shingles in all are gone through whole, larger ones in blocks.
BLOCK_SHINGLES = 250_000

_RNG = np.random.default_rng(20210101)
_FACTOR = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of registers per set ``hashes[bounds[i]:bounds[i + 1]]``; an empty set has zeros."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    full = np.nonzero(np.diff(bounds))[0]
    if not len(full):
        return out
    least = np.empty((len(full), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(hashes * _FACTOR[i] + _SHIFT[i], bounds[full])
    exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0 ** 64 * (1 - 1e-16)) / RATE
    level = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE))
    out[full] = np.clip(level, 0, LIMIT).astype(np.uint16)
    return out


def log_likelihood(j, up, down, same, u, v):
    """Of similarity ``j`` given how many registers are larger, smaller and equal.

    ``u`` and ``v`` are the sets' shares of the sum of their sizes.
    """

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return (up * np.log(above + tiny) + down * np.log(below + tiny)
            + same * np.log(np.maximum(1 - above - below, tiny)))


def plausible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
              least: float) -> np.ndarray:
    """Which pairs of register rows may have a similarity of ``least`` or more."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)
    steps = np.linspace(0, 1, 41)[None, :]
    counts = up[:, None], down[:, None], same[:, None], u[:, None], v[:, None]
    best = log_likelihood(steps * most[:, None], *counts).max(1)
    # The likelihood has one peak, so the best of all similarities from the threshold up.
    low = np.minimum(least, most)[:, None]
    at = log_likelihood(low + steps * (most[:, None] - low), *counts).max(1)
    return (most >= least - 1e-9) & (best - at <= MARGIN)


def _as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _digests(bounds: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """128 bits of each set, whatever the order of its members."""
    sizes = np.diff(bounds).astype(np.uint64)
    out = np.empty((len(sizes), 2), np.uint64)
    for i, salt in enumerate((11, 23)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, i] = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes)
    return _as_binary(out)


def _sketches(width: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for row, bounds, hashes in shingle_sets(batch.column("text"), width):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(row, n), batch.column("ref").slice(row, n),
                    pa.array(np.diff(bounds).astype(np.int64)), _digests(bounds, hashes),
                    _as_binary(registers(bounds, hashes))], schema=out)

    return run


def _bands(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            regs = as_registers(batch.column(1))
            for band in range(REGISTERS // BAND):
                key = np.full(len(regs), band, np.uint64)
                for i in range(band * BAND, (band + 1) * BAND):
                    key = mix64(key * np.uint64(31) + regs[:, i].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0)], schema=out)

    return run


def as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            keep = plausible(
                as_registers(batch.column("regs_a")), as_registers(batch.column("regs_b")),
                *(batch.column(x).to_numpy(zero_copy_only=False) for x in ("n_a", "n_b")), least)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(width: int, out: pa.Schema):
    """Sets of the texts that have the digest they were asked for by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for row, bounds, hashes in shingle_sets(batch.column("text"), width):
                n = len(bounds) - 1
                found = pa.RecordBatch.from_arrays([
                    batch.column("id").slice(row, n), list_array(pa.array(hashes.view(np.int64)), bounds)], schema=out)
                yield found.filter(pc.equal(_digests(bounds, hashes), batch.column("digest").slice(row, n)))

    return run


def _across(percent: int, out: pa.Schema):
    """Links across components within buckets: every ``left`` row against all rows of its bucket.

    A link that joins two components is given out and merges them, so a bucket gives fewer links
    than it has rows. Intersections are counted exactly: the row's shingles are marked in the
    bucket's list of shingles, and marks are summed up by row.
    """

    def run(group: pa.Table) -> pa.Table:
        forget_kept()
        group = group.sort_by("key")
        key, left = (group.column(c).to_numpy() for c in ("key", "left"))
        component = group.column("component").combine_chunks().dictionary_encode()
        root = component.indices.to_numpy(zero_copy_only=False).copy()
        shingles = group.column("shingles").combine_chunks()
        sizes = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = shingles.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        pairs = []
        cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
        for lo, hi in zip(cuts, cuts[1:]):
            start = ends[lo] - sizes[lo]
            _, code = np.unique(flat[start:ends[hi - 1]], return_inverse=True)
            at = ends[lo:hi] - sizes[lo:hi] - start
            n, own = sizes[lo:hi], root[lo:hi]
            marks = np.zeros(int(code.max()) + 1, np.int64)
            for y in np.nonzero(left[lo:hi])[0]:
                if (own == own[y]).all():
                    continue
                mine = code[at[y]:at[y] + n[y]]
                marks[mine] = 1
                both = np.add.reduceat(marks[code], at)
                marks[mine] = 0
                linked = np.nonzero(100 * both >= percent * (n + n[y] - both))[0]
                for x in linked[own[linked] != own[y]]:
                    if own[x] != own[y]:
                        pairs.append((lo + y, lo + x))
                        own[own == own[x]] = own[y]
        ids = group.column("id").combine_chunks()
        picks = [pa.array([p[side] for p in pairs], pa.int64()) for side in (0, 1)]
        return pa.Table.from_arrays([ids.take(x) for x in picks], schema=out)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of ``width`` words, lower-cased in A-Z; a text of
    fewer words has its whole word sequence as one shingle. Two texts are linked when
    100 * intersection >= percent * union. component_id is the least id reachable by links,
    kept whether that is the row's own. Null texts and texts without words have empty sets and
    are linked with nothing, not even each other. Rows that repeat an id are one document,
    linked with all that any of its texts is linked with. Rows without an id are each linked by
    their own text and get the least id of their component, null if it has none; they are not
    kept. Other columns are not looked at; an empty table gives an empty result. Sets are
    compared by 64-bit hashes of shingles, equal sets by 128-bit digests.
    """
    spark = docs.sparkSession
    least = percent / 100
    given = StructField("id", docs.schema[id_col].dataType)
    number = StructField("id", LongType())

    def arrow(schema: StructType) -> pa.Schema:
        return spark.createDataFrame([], schema).toArrow().schema

    text = F.coalesce(F.col(text_col), F.lit(""))
    # ref finds a class's text again: the hash of a row's id and text.
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(id_col, text).alias("ref"))
    sketch = StructType([given, StructField("ref", LongType()), StructField("n", LongType()),
                         StructField("digest", BinaryType()), StructField("regs", BinaryType())])
    sketches = materialize(whole.mapInArrow(_sketches(width, arrow(sketch)), sketch), "sketches")
    classes = materialize(sketches.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("least"), F.min("ref").alias("ref"), F.any_value("n").alias("n"),
        F.any_value("regs").alias("regs")).withColumn("id", F.monotonically_increasing_id()), "classes")

    band = StructType([StructField("key", LongType()), number])
    bands = classes.select("id", "regs").mapInArrow(_bands(arrow(band)), band)
    buckets = bands.groupBy("key").agg(
        F.min("id").alias("star"), F.count("*").alias("members")).filter("members > 1")
    crowd = materialize(bands.join(buckets, "key"), "buckets")

    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])
    set_schema = StructType([number, StructField("shingles", ArrayType(LongType()))])

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, shingles) of classes in a stored table; a text that many rows have is sent once a task."""
        asked = materialize(classes.join(ids.distinct(), "id", "left_semi").select("id", "ref", "digest"), "asked")
        texts = possibly_in(whole.select("ref", "text"), asked.select(F.col("ref").alias("id")), "ref").groupBy(
            "ref").agg(F.any_value("text").alias("text"))
        return texts.join(asked.hint("merge"), "ref").select("id", "digest", "text").mapInArrow(
            _sets(width, arrow(set_schema)), set_schema)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        sets = materialize(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))), "sets")
        a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
                for x in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        either = F.size("set_a") + F.size("set_b") - both
        return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * either).select("a", "b")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"),
                              F.col("regs").alias(f"regs_{x}"))

    stars = crowd.filter("id != star").select(F.col("id").alias("a"), F.col("star").alias("b"))
    likely = stars.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(
        _likely(least), pair)
    links = materialize(confirmed(likely).union(_links_by_id(sketches, classes)), "links")
    labels = connected_components(links)

    # A second look at buckets of several components; a bucket of two is settled by its star.
    # Rows outside a bucket's largest component meet all others of the bucket: in one task for
    # most buckets, else in blocks of bounded size. Rows of the largest never meet each other.
    labelled = materialize(
        crowd.filter("members > 2").select("key", "id").join(
            labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")).join(
            classes.select("id", "n"), "id"), "labelled")
    prints = [F.xxhash64("id", F.lit(salt)) for salt in (1, 2)]
    of_component = labelled.groupBy("key", "component").agg(
        F.count("*").alias("rows"), F.sum("n").alias("weight"),
        *[F.bit_xor(p).alias(f"print{i}") for i, p in enumerate(prints)])
    split = of_component.groupBy("key").agg(
        F.max(F.struct("rows", "component", "weight")).alias("top"), F.sum("weight").alias("all"),
        F.count("*").alias("components"), F.sum("rows").alias("rows"),
        *[F.bit_xor(f"print{i}").alias(f"print{i}") for i in (0, 1)]).filter("components > 1")
    alike = split.groupBy("rows", "print0", "print1").agg(F.min(F.struct("key", "top", "all")).alias("one"))
    split = alike.select(
        "one.key", F.col("one.top.component").alias("major"),
        F.ceil((F.col("one.all") - F.col("one.top.weight")) / BLOCK_SHINGLES).cast("int").alias("minors"),
        F.ceil(F.col("one.top.weight") / BLOCK_SHINGLES).cast("int").alias("majors"))
    members = materialize(labelled.join(split, "key"), "split-buckets")
    total = members.agg(F.sum("n")).first()[0] or 0
    slots = partitions_for(spark, total, BLOCK_SHINGLES)
    minor = ~F.col("component").eqNullSafe(F.col("major"))
    own = F.pmod(F.hash("id"), F.when(minor, F.col("minors")).otherwise(F.col("majors")))

    def block(kind: int, a: Column, b: Column, left: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"),
                        F.lit(left).alias("left"))

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    mine = F.col("own")
    as_minor = F.concat(
        F.transform(upto(F.col("majors")), lambda j: block(0, mine, j, True)),
        F.transform(F.filter(upto(F.col("minors")), lambda j: j > mine), lambda j: block(1, mine, j, True)),
        F.transform(F.filter(upto(F.col("minors")), lambda i: i < mine), lambda i: block(1, i, mine, False)))
    as_major = F.transform(upto(F.col("minors")), lambda i: block(0, i, mine, False))
    one = (F.col("minors") == 1) & (F.col("majors") == 1)
    placed = members.withColumn("own", own).withColumn(
        "at", F.explode(F.when(minor, as_minor).otherwise(as_major))).select(
        "key", "id", "component", "at.*",
        F.when(one, F.pmod(F.col("key"), F.lit(slots))).otherwise(F.col("key")).alias("slot"))
    more = placed.join(sets_of(members.select("id")), "id").groupBy(
        "slot", "kind", "a", "b").applyInArrow(_across(percent, arrow(pair)), pair)
    labels = connected_components(links.union(more))

    # From numbers back to ids: the least of a component, by class, and by id for empty texts.
    of_class = classes.select("id", "digest", "least").join(
        labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    heads = of_class.groupBy("component").agg(F.min("least").alias("head"))
    named = materialize(of_class.join(heads, "component").select("digest", "head"), "components")
    filled = sketches.select("id", "n", "digest").join(
        named.withColumnRenamed("digest", "of"), (F.col("n") > 0) & (F.col("digest") == F.col("of")), "left")
    of_ids = _several_texts(sketches).join(sketches.filter("n > 0").select("id", "digest"), "id").join(
        named, "digest").groupBy("id").agg(F.min("head").alias("other")).withColumnRenamed("id", "same")
    component = F.coalesce("head", "other", "id")
    return filled.join(of_ids, F.col("id") == F.col("same"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _several_texts(sketches: DataFrame) -> DataFrame:
    """(id) of documents whose rows have different sets."""
    mark = F.xxhash64("digest")
    return sketches.filter("id is not null").groupBy("id").agg(
        F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("id")


def _links_by_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one id lie in, to the least of them."""
    of_id = sketches.filter("n > 0").select("id", "digest").join(_several_texts(sketches), "id").join(
        classes.select(F.col("id").alias("a"), "digest"), "digest").select("id", "a").distinct()
    first = of_id.groupBy("id").agg(F.min("a").alias("b"))
    return of_id.join(first, "id").filter("a <> b").select("a", "b")
