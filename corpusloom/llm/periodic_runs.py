"""Periodic runs of words: stretches that repeat themselves, found from Lyndon roots.

A run's root, its period's worth of words in the right rotation, is the longest Lyndon word at
its start under the order of the words or under the reverse of it. So two Lyndon arrays name all
candidates, and longest common extensions to both sides of a root tell where its run ends.

1. Phase one of Baier's suffix sorter groups suffixes by their longest Lyndon prefix. Its groups'
   context lengths are the Lyndon array, so the suffixes never need to be sorted to the end. It
   is done under both orders.
2. Each root is extended by longest common extensions of its start and its end, forward and
   backward, by binary search over prefix hashes; every run found is then compared word by word.

Before that, a sieve leaves out words that no run can hold. In a run of period q and at least
four periods every word but those of the last period comes again within q words, and these are
at least 3 q in a row. So a stretch of L such words can only keep words that come again within
L / 3, until nothing changes. Ordinary prose hardly survives, runs always do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.llm.common import list_array, mix64, small_slices

#: A run has at least LEAST words and PERIODS periods.
LEAST = 6
PERIODS = 4
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.iinfo(np.int64).max


def lyndon_array(text: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position.

    Groups of suffixes with a common prefix (their context) are taken from the largest to the
    smallest. The members of the group at hand are finished, their context is their longest
    Lyndon prefix. The nearest unfinished position before a member is extended by the member's
    context, as often as members point to it: it moves to a group just above its own.
    """
    n = len(text)
    letters = sorted(set(text))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * len(letters)
    below = list(range(-1, len(letters) - 1))
    above = list(range(1, len(letters) + 1))
    out = [0] * n
    # before[i] leads to the nearest unfinished position up to i - 1, counted from 1; 0 is none.
    before = list(range(n + 1))
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        width = context[g]
        for i in own:
            out[i] = width
            before[i + 1] = i
        pointers: dict[int, int] = {}
        for i in own:
            j = i
            while before[j] != j:
                before[j] = before[before[j]]
                j = before[j]
            if j:
                pointers[j - 1] = pointers.get(j - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointers.items():
            moved.setdefault((-times, group[j]), []).append(j)
        for (times, old), suffixes in sorted(moved.items()) if len(moved) > 1 else moved.items():
            new = len(members)
            for j in suffixes:
                group[j] = new
            members.append(suffixes)
            context.append(context[old] - times * width)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
        g = below[g]
    return out


def sieve(words: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of positions outside of which no run lies."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = np.nonzero(words[order[1:]] == words[order[:-1]])[0]
    gap = np.full(n, _NEVER)
    gap[order[same]] = order[same + 1] - order[same]
    at = np.nonzero(gap < n)[0]
    while len(at):
        edges = np.concatenate([[0], np.nonzero(np.diff(at) != 1)[0] + 1, [len(at)]])
        lengths = np.diff(edges)
        of = np.repeat(lengths, lengths)
        keep = (of >= LEAST - 1) & (gap[at] <= of // (PERIODS - 1))
        if keep.all():
            ranges: list[tuple[int, int]] = []
            for lo, size in zip(at[edges[:-1]].tolist(), lengths.tolist()):
                hi = min(n, lo + size + size // (PERIODS - 1))
                if ranges and lo <= ranges[-1][1]:
                    lo, hi = ranges[-1][0], max(hi, ranges.pop()[1])
                ranges.append((lo, hi))
            return ranges
        at = at[keep]
    return []


class Extensions:
    """Longest common extensions of positions ``i`` and ``i + p`` by hashes of prefixes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.n, _BASE))])
        value = mix64(words.astype(np.uint64)) * self.power[:-1]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])

    def _search(self, least: np.ndarray, equal) -> np.ndarray:
        size = np.zeros(len(least), np.int64)
        step = 1 << max(0, int(least.max()).bit_length() - 1) if len(least) else 0
        while step:
            more = size + step
            ok = np.nonzero(more <= least)[0]
            ok = ok[equal(ok, more[ok])]
            size[ok] += step
            step >>= 1
        return size

    def _equal(self, i, p, size):
        left = (self.sums[i + size] - self.sums[i]) * self.power[p]
        return left == self.sums[i + p + size] - self.sums[i + p]

    def forward(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self._search(np.maximum(0, self.n - i - p), lambda k, m: self._equal(i[k], p[k], m))

    def backward(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self._search(i, lambda k, m: self._equal(i[k] - m, p[k], m))


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in a sequence of numbered words, sorted."""
    ranges = sieve(words)
    if not ranges:
        return np.zeros((0, 3), np.int64)
    # The ranges one after the other, each behind a word of its own.
    parts, places = [], []
    for k, (lo, hi) in enumerate(ranges):
        parts += [words[lo:hi], np.array([-1 - k], words.dtype)]
        places.append(np.arange(lo, hi + 1))
    places = np.concatenate(places)
    _, rank = np.unique(np.concatenate(parts), return_inverse=True)
    found = []
    for sign in (1, -1):
        period = np.array(lyndon_array((sign * rank).tolist()), np.int64)
        found.append(np.column_stack([places, period]))
    at, period = np.unique(np.concatenate(found), axis=0).T
    n = len(words)
    behind = at + period
    right = (behind < n) & (words[np.minimum(at, n - 1)] == words[np.minimum(behind, n - 1)])
    left = (at > 0) & (behind <= n) & (words[at - 1] == words[np.minimum(behind, n) - 1])
    at, period = at[right | left], period[right | left]
    reach = Extensions(words)
    start = at - reach.backward(at, period)
    length = at + period + reach.forward(at, period) - start
    whole = length >= np.maximum(LEAST, PERIODS * period)
    runs = np.unique(np.column_stack([start, length, period])[whole], axis=0)
    exact = np.concatenate([runs[:0], *(_by_word(words, *run) for run in runs.tolist())])
    exact = exact[np.lexsort((exact[:, 2], exact[:, 1], exact[:, 0]))]
    fresh = np.ones(len(exact), bool)  # of equal stretches the one of the smallest period
    fresh[1:] = (exact[1:, :2] != exact[:-1, :2]).any(1)
    exact = exact[fresh]
    return exact[np.lexsort((exact[:, 2], exact[:, 0]))]


def _by_word(words: np.ndarray, start: int, length: int, period: int) -> np.ndarray:
    """The runs of a period in a range whose ends are maximal: the range, or what is left of it
    where different words happened to have equal hashes."""
    differs = np.nonzero(words[start:start + length - period] != words[start + period:start + length])[0]
    edges = np.concatenate([[-1], differs, [length - period]])
    sizes = np.diff(edges) - 1 + period
    runs = np.column_stack([start + edges[:-1] + 1, sizes, np.full(len(sizes), period)])
    return runs[sizes >= max(LEAST, PERIODS * period)]


def _collapsed(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small_slices(batch, size=SLICE_BYTES):
                texts = [t.encode().split() for t in rows.column(1).to_pylist()]
                numbers: dict[bytes, int] = {}
                numbered = []
                for k, words in enumerate(texts):
                    numbered += [numbers.setdefault(w, len(numbers)) for w in words]
                    numbered.append(-1 - k)  # no run goes beyond its text
                sizes = np.array([len(words) for words in texts], np.int64)
                base = np.cumsum(sizes + 1) - sizes - 1
                runs = runs_of(np.array(numbered, np.int64))
                text = np.searchsorted(base, runs[:, 0], side="right") - 1
                runs[:, 0] -= base[text]
                kept = [*texts]
                for k in np.unique(text):
                    stays = np.ones(sizes[k], bool)
                    for start, length, period in runs[text == k]:
                        stays[start + period:start + length] = False
                    kept[k] = [w for w, s in zip(texts[k], stays.tolist()) if s]
                cells = pa.StructArray.from_arrays(
                    [pa.array(runs[:, c]) for c in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(sizes),
                    list_array(cells, np.searchsorted(text, np.arange(len(texts) + 1))),
                    pa.array([b" ".join(words).decode() for words in kept], pa.string())], schema=out)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period), collapsed.

    A run is a stretch of words with smallest period q and at least max(6, 4 q) words that its
    neighbours do not extend; runs are sorted by start, then period. ``collapsed`` is the text's
    words without those that a run has after its first period, joined by one space. Words are
    compared as they are. Null texts are empty and have no words; rows without an id or with a
    repeated one are each judged by their own text. Columns of other names are not looked at; an
    empty table gives an empty result. A task holds some SLICE_BYTES of text or one text.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = StructType([StructField(x, LongType()) for x in ("start", "length", "period")])
    schema = StructType([StructField("id", whole.schema["id"].dataType), StructField("n_words", LongType()),
                         StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    arrow = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    return whole.mapInArrow(_collapsed(arrow), schema).withColumnRenamed("id", id_col)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with one document in ten made periodic from some word on, by its id's CRC-32.

    Documents without an id, and those without words, stay as they are.
    """
    number = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr("0").alias("zero"),
        F.floor(number / 10).alias("g"), F.when(number % 10 == 0, words).alias("words"))
    sized = marked.withColumn("n", F.size("words")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("""array_join(slice(concat(slice(words, 1, cast(a as int)), flatten(array_repeat(
        slice(words, cast(a as int) + 1, cast(p as int)), cast(ceil((n - a) / p) as int)))), 1, n), ' ')""")
    return sized.select(F.col("id").alias(id_col),
                        F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias(text_col))


def run_digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``periodic_runs``: id, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli; null without runs; the first of equals), runs_sha256, collapsed_sha256."""
    greater = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    nothing = F.lit(None).cast(runs.schema["runs"].dataType.elementType)
    best = F.aggregate("runs", nothing, lambda a, r: F.when(greater(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return runs.select(id_col, "runs", "collapsed", best.alias("best")).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
