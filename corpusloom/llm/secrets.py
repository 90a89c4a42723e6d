"""Secrets in texts: three fixed patterns, and runs of characters that look random.

A run of one character class is slid through by a window. Counts of the window's characters
change by one character going out and one coming in, and so does the sum of c * log2(c) over
the counts, from which the window's Shannon entropy follows. What the allow list names is left
out: window by window, or with the whole run. All of it is column expressions; no row leaves
its place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The base patterns, which of their groups is measured, and its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
               r"([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}


@dataclass(frozen=True)
class RandomRun:
    """A character class, its window and the least entropy in bits that counts as random.

    ``needs`` are patterns that a run must all contain: long words have letters only.
    """

    kind: str
    chars: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()


RUNS = (
    RandomRun("entropy_hex", "0-9A-Fa-f", 24, 2.8, ("[0-9]", "[A-Fa-f]")),
    RandomRun("entropy_base64", "A-Za-z0-9+/=_-", 28, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
    # Keys of one case, such as base36 and base32: their runs need no letter of the other.
    RandomRun("entropy_lower", "0-9a-z", 24, 3.7, ("[0-9]", "[a-z]")),
    RandomRun("entropy_upper", "0-9A-Z", 16, 3.2, ("[0-9]", "[A-Z]")),
)
#: Runs, or windows, with one of these are known not to be secrets: placeholders, alphabets, UUIDs.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|lorem",
    r"(?i)01234567|abcdefgh|(.)\1{7}",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
)
#: The one of these that is longer than a window: runs are cut where it matches.
WHOLE = ALLOWED[2]
KINDS = (*BASE, *(r.kind for r in RUNS))
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"
_SCALE = 1_000_000
_FIRST, _SLOTS = 43, 80  # '+' to 'z'


def _found(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of matches, from the matches and the pieces of text between them."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    none = F.array().cast(_SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                                x["match"].alias("text"))).cast(_SPAN)
        long_enough = F.coalesce(F.length(x["part"]), F.lit(-1)) >= least
        return F.struct(end.cast("long").alias("at"), F.when(
            long_enough, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add,
                       lambda acc: acc["out"])


def _base_spans(text: Column) -> Column:
    """All base spans, by start. A cheap test keeps most texts away from the patterns."""
    lower = F.lower(text)
    words = [lower.contains(w) for w in ("passw", "secret", "token", "api")]
    worth = {
        "assign": words[0] | words[1] | words[2] | words[3],
        "access": text.contains("AKIA"),
        "hex": text.rlike("(?<![0-9a-f])[0-9a-f]{32}"),
    }
    none = F.array().cast(_SPAN)
    return F.array_sort(F.concat(*[
        F.when(worth[name], _found(text, pattern, KINDS.index(name), group, least)).otherwise(none)
        for name, (pattern, group, least) in BASE.items()]))


def _random_parts(run: Column, rule: RandomRun, by_window: bool) -> Column:
    """array of struct(first, last): windows over the limit that the allow list does not name,
    those that meet joined to one; or, not by window, one from the first to the last."""
    size = rule.window
    table = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(size + 1)])
    most = math.floor((math.log2(size) - rule.bits) * size * _SCALE)
    codes = F.transform(F.slice(F.split(run, ""), F.lit(1), F.length(run)),
                        lambda c: F.ascii(c) - _FIRST)
    leaving = F.concat(F.array_repeat(F.lit(-1), size), codes)
    steps = F.zip_with(codes, F.slice(leaving, F.lit(1), F.length(run)),
                       lambda a, b: F.struct(a.alias("new"), b.alias("old")))

    def value(count: Column) -> Column:
        return F.get(table, count)

    known = F.lit(False)
    for allowed in ALLOWED:
        known = known | run.rlike(allowed)

    def slide(acc: Column, x: Column) -> Column:
        new, old, counts = x["new"], x["old"], acc["counts"]
        grown, shrunk = F.get(counts, new), F.get(counts, old)
        change = F.when(new == old, 0).otherwise(
            value(grown + 1) - value(grown)
            + F.when(old >= 0, value(shrunk - 1) - value(shrunk)).otherwise(0))
        total = acc["total"] + change
        at = acc["at"] + 1
        hit = (at >= size) & (total <= most)
        seen, closed = F.lit(""), acc["out"]
        fresh = acc["first"] < 0
        if by_window:
            # The window's own text; only runs with something known in them need it.
            seen = F.when(acc["known"], F.concat(F.substring(acc["seen"], -(size - 1), size - 1), F.char(
                new + _FIRST))).otherwise("")
            for allowed in ALLOWED:
                hit = hit & ~seen.rlike(allowed)
            apart = hit & ~fresh & (at - size > acc["last"])
            closed = F.when(apart, F.concat(closed, F.array(F.struct(
                acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(closed)
            fresh = fresh | apart
        return F.struct(
            F.when(new == old, counts).otherwise(F.transform(counts, lambda c, i: (
                c + F.when(i == new, 1).otherwise(0) - F.when(i == old, 1).otherwise(0)))).alias("counts"),
            total.cast("long").alias("total"), at.cast("int").alias("at"),
            F.when(hit & fresh, at - size).otherwise(acc["first"]).cast("int").alias("first"),
            F.when(hit, at).otherwise(acc["last"]).cast("int").alias("last"),
            acc["known"].alias("known"), seen.alias("seen"), closed.alias("out"))

    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("counts"), F.lit(0).cast("long").alias("total"),
                     F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
                     known.alias("known"), F.lit("").alias("seen"), none.alias("out"))
    return F.aggregate(steps, start, slide, lambda acc: F.when(acc["first"] >= 0, F.concat(
        acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(none))


def _random_spans(text: Column, rule: RandomRun, by_window: bool) -> Column:
    """Spans of random looking parts of runs, without what the allow list names."""
    pattern = f"(?<![{rule.chars}])[{rule.chars}]{{{rule.window},}}"
    runs = F.when(text.rlike(pattern), _found(
        text, pattern, KINDS.index(rule.kind), 0, rule.window)).otherwise(F.array().cast(_SPAN))

    def secret_like(run: Column) -> Column:
        test = F.lit(True)
        for needed in rule.needs:
            test = test & run["text"].rlike(needed)
        if not by_window:
            for allowed in ALLOWED:
                test = test & ~run["text"].rlike(allowed)
        return test

    def pieces(run: Column) -> Column:
        """The run without what is known and longer than a window, as spans."""
        found = _found(run["text"], WHOLE, 0, 0, 0)
        cut = F.aggregate(
            found, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["out"], F.array(
                piece(run, acc["at"], m["start"]))).alias("out")),
            lambda acc: F.concat(acc["out"], F.array(piece(run, acc["at"], F.length(run["text"])))))
        return F.when(run["text"].rlike(WHOLE), F.filter(
            cut, lambda p: F.length(p["text"]) >= rule.window)).otherwise(F.array(run).cast(_SPAN))

    def piece(run: Column, start: Column, end: Column) -> Column:
        return F.struct((run["start"] + start).alias("start"), run["kind"].alias("kind"),
                        (run["start"] + end).cast("long").alias("end"), F.substring(
                            run["text"], (start + 1).cast("int"), (end - start).cast("int")).alias("text"))

    def narrowed(run: Column) -> Column:
        return F.transform(_random_parts(run["text"], rule, by_window), lambda p: F.struct(
            (run["start"] + p["first"]).alias("start"), run["kind"].alias("kind"),
            (run["start"] + p["last"]).alias("end"), F.lit("").alias("text")))

    likely = F.filter(runs, secret_like)
    if by_window:
        likely = F.flatten(F.transform(likely, pieces))
    return F.flatten(F.transform(likely, narrowed)).cast(_SPAN)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 by_window: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Base spans are whole matches; all of them stay. ``by_window`` finds all random parts: the
    allow list leaves out the windows that hold one of its names (and UUIDs whole), windows over
    the limit that meet are one part, and what a base span or an earlier class has of a part is
    taken off it. Without it the allow list leaves out whole runs, a run is told once, from its
    first window over the limit to its last, and only where it touches nothing told before, so
    secrets beside known words or base spans are missing. Positions count code points, ends are
    exclusive. Null texts are empty, ids may be null or repeat, other columns are not looked at;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", _base_spans(F.col("text")).alias("base"),
                       *[_random_spans(F.col("text"), r, by_window).alias(r.kind) for r in RUNS])

    def apart(spans: Column, others: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(others, lambda o: (
            (o["start"] < s["end"]) & (s["start"] < o["end"]))))

    def left(spans: Column, others: Column) -> Column:
        """What the others, sorted, leave of each span."""
        def part(s: Column, start: Column, end: Column) -> Column:
            return F.when(start < end, F.array(F.struct(
                start.alias("start"), s["kind"].alias("kind"), end.alias("end"),
                F.lit("").alias("text")))).otherwise(F.array()).cast(_SPAN)

        def rest(s: Column) -> Column:
            return F.aggregate(
                F.filter(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])),
                F.struct(s["start"].alias("at"), F.array().cast(_SPAN).alias("out")),
                lambda acc, o: F.struct(F.greatest(acc["at"], o["end"]).alias("at"), F.concat(
                    acc["out"], part(s, acc["at"], o["start"])).alias("out")),
                lambda acc: F.concat(acc["out"], part(s, acc["at"], s["end"])))

        return F.flatten(F.transform(spans, rest))

    for i, rule in enumerate(RUNS):
        known = F.col("known") if i else F.col("base")
        new = (left if by_window else apart)(F.col(rule.kind), known)
        rows = rows.withColumn("known", F.array_sort(F.concat(known, new)))
    rows = rows.select("id", "base", F.col("known").alias("every"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    return rows.select(
        F.col("id").alias(id_col), *[number(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_entropy"))
