"""Repair of conversations by a generalised LR parser over the grammar of roles.

A conversation is a word of role initials, and the grammar says which are sound: an optional
system message, then pairs of a user's and an assistant's. An SLR automaton is made from the
grammar. Where its input breaks off or does not fit, a parse goes on along several stacks: a row
may be deleted, given another role, or preceded by inserted empty messages, each at a price.
Stacks share their lower parts: a vertex is a state on top of another vertex, and stacks with
equal tops are one vertex, which keeps the least (cost, audit) of all ways to it. An audit has
an initial per edit; of equally cheap repairs the one with the least audit is taken.

How it runs: rows are noted with their faults, dealt out by ranges of (conversation, turn) and
sorted. A conversation may go over several tasks: a piece of it is parsed from every vertex it
might begin on, and pieces are put together afterwards, so no task holds a whole conversation's
rows. Edits and rows meet by (conversation, place), which no two rows share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType)

from corpusloom.llm.common import partitions_for, string_buffers
from corpusloom.session import materialize

#: The grammar (a dialogue is empty, a system message and pairs, or pairs), the
#: prices of edits, and what a kept row that breaks off costs on top.
RULES = (("dialogue", ()), ("dialogue", ("s", "pairs")), ("dialogue", ("pairs",)),
         ("pairs", ("pairs", "pair")), ("pairs", ("pair",)), ("pair", ("u", "a")))
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

ROWS_PER_TASK = 200_000
#: Rows of a conversation that are parsed in one piece.
PIECE_ROWS = 20_000
END = "$"


class Automaton:
    """The SLR tables of a grammar: ``shift[state][terminal]``, ``goto[state][name]`` and
    ``reduce[state][terminal]`` with a rule's number; ``done`` are states of a whole dialogue."""

    def __init__(self, rules):
        names = {name for name, _ in rules}
        start = rules[0][0]
        rules = (*rules, ("start", (start,)))
        self.rules = rules

        def closure(items):
            items = set(items)
            while True:
                wanted = {rules[r][1][dot] for r, dot in items if dot < len(rules[r][1])}
                more = {(r, 0) for r, (name, _) in enumerate(rules) if name in wanted} - items
                if not more:
                    return frozenset(items)
                items |= more

        empty = {name for name, body in rules if not body}
        first = {name: set() for name in (*names, "start")}
        follow = {name: {END} if name == "start" else set() for name in (*names, "start")}
        for _ in range(sum(len(body) + 1 for _, body in rules)):
            for name, body in rules:
                after = set(follow[name])
                for symbol in reversed(body):
                    if symbol in names:
                        follow[symbol] |= after
                        after = first[symbol] | (after if symbol in empty else set())
                    else:
                        after = {symbol}
                for symbol in body:
                    first[name] |= first[symbol] if symbol in names else {symbol}
                    if symbol not in empty:
                        break
        states = [closure([(len(rules) - 1, 0)])]
        self.shift, self.goto, self.reduce, self.done = [], [], [], set()
        for number, items in enumerate(states):
            moves: dict[str, set] = {}
            reduce = {}
            for r, dot in items:
                name, body = rules[r]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((r, dot + 1))
                elif name == "start":
                    self.done.add(number)
                else:
                    reduce |= dict.fromkeys(follow[name], r)
            to = {}
            for symbol, kernel in moves.items():
                target = closure(kernel)
                if target not in states:
                    states.append(target)
                to[symbol] = states.index(target)
            self.shift.append({x: to[x] for x in to if x not in names})
            self.goto.append({x: to[x] for x in to if x in names})
            self.reduce.append(reduce)


class Stacks:
    """Graph-structured stacks: vertex 0 is the empty stack, others a state on a vertex."""

    def __init__(self, automaton: Automaton):
        self.of = automaton
        self.state, self.below, self.known = [0], [-1], {}
        at = 0
        while at < len(self.state):  # all vertices that terminals lead to
            for terminal in ("s", "u", "a"):
                self.advance(at, terminal)
            at += 1

    def _push(self, vertex: int, state: int) -> int:
        if (vertex, state) not in self.known:
            self.known[vertex, state] = len(self.state)
            self.state.append(state)
            self.below.append(vertex)
        return self.known[vertex, state]

    def _reduced(self, vertex: int, rule: int) -> int:
        name, body = self.of.rules[rule]
        for _ in body:
            vertex = self.below[vertex]
        return self._push(vertex, self.of.goto[self.state[vertex]][name])

    def advance(self, vertex: int, terminal: str) -> int | None:
        """The stack after a terminal, None if it does not fit."""
        while terminal not in self.of.shift[self.state[vertex]]:
            rule = self.of.reduce[self.state[vertex]].get(terminal)
            if rule is None:
                return None
            vertex = self._reduced(vertex, rule)
        vertex = self._push(vertex, self.of.shift[self.state[vertex]][terminal])
        # A state that can only reduce does so whatever comes, so stacks stay short.
        while not self.of.shift[self.state[vertex]] and len(set(self.of.reduce[self.state[vertex]].values())) == 1:
            vertex = self._reduced(vertex, next(iter(self.of.reduce[self.state[vertex]].values())))
        return vertex

    def accepts(self, vertex: int) -> bool:
        while self.state[vertex] not in self.of.done:
            rule = self.of.reduce[self.state[vertex]].get(END)
            if rule is None:
                return False
            vertex = self._reduced(vertex, rule)
        return True


def _tables():
    """(vertices, moves, ends). ``moves[kind][vertex]`` has (vertex, cost, audit, roles) of all
    ways over a row: inserted messages, then an edit of the row; ``ends[vertex]`` is the cheapest
    (cost, audit, roles) to a whole dialogue. A kind is a role initial and a fault."""
    stacks = Stacks(Automaton(RULES))
    vertices = range(len(stacks.state))

    def inserted(vertex):
        ways, seen = [(vertex, "")], {vertex}
        for at, roles in ways:
            for role in ROLES:
                to = stacks.advance(at, role)
                if to is not None and to not in seen:
                    seen.add(to)
                    ways.append((to, roles + role))
        return ways

    def least(ways):
        best: dict = {}
        for to, *way in ways:
            if to not in best or way < best[to]:
                best[to] = way
        return [(to, *way) for to, way in best.items()]

    def over(vertex, initial, fault):
        for at, roles in inserted(vertex):
            cost, audit = INSERT * len(roles), "I" * len(roles)
            yield at, cost + DELETE, audit + "D", roles + "-"
            if fault != "x":
                cost += TRUNCATED * (fault == "t")
                for role in ROLES:
                    to = stacks.advance(at, role)
                    if to is not None:
                        yield to, cost + REROLE, audit + "R", roles + role
                to = stacks.advance(at, initial) if initial != "-" else None
                if to is not None:
                    yield to, cost, audit + "K", roles + initial

    moves = {initial + fault: [least(over(v, initial, fault)) for v in vertices]
             for initial in "sua-" for fault in ".tx"}
    ends = [min((INSERT * len(roles), "I" * len(roles), roles)
                for at, roles in inserted(v) if stacks.accepts(at)) for v in vertices]
    return vertices, moves, ends


VERTICES, MOVES, ENDS = _tables()


def parse(kinds: list[str], start: int = 0) -> dict[int, tuple[int, str, str]]:
    """Least (cost, audit, roles) from a vertex over rows, by the vertex they end on.

    Audits are compared without being written out: all audits of a level have an edit per row,
    and one edit with the inserts before it never begins another, so their order is that of the
    level before, then of what was added.
    """
    front = {start: (0, 0, None)}
    for kind in kinds:
        best: dict = {}
        ways = MOVES[kind]
        for vertex, (cost, rank, way) in front.items():
            for to, more, audit, roles in ways[vertex]:
                new = (cost + more, rank, audit)
                if to not in best or new < best[to][0]:
                    best[to] = (new, way, roles)
        places = {x: i for i, x in enumerate(sorted({new[1:] for new, _, _ in best.values()}))}
        front = {to: (new[0], places[new[1:]], (way, new[2], roles)) for to, (new, way, roles) in best.items()}
    out = {}
    for to, (cost, _, way) in front.items():
        audits, roles = [], []
        while way:
            way, audit, role = way
            audits.append(audit)
            roles.append(role)
        out[to] = cost, "".join(reversed(audits)), "".join(reversed(roles))
    return out


_PATH = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                    StructField("cost", LongType()), StructField("audit", StringType()),
                    StructField("roles", StringType())])
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


class _Piece:
    """Rows of one conversation in a task, one after the other."""

    def __init__(self, conv, number: int, opened: bool):
        self.conv, self.number, self.opened = conv, number, opened
        self.kinds: list[str] = []
        self.count = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = None
        self.initials = ["", ""]

    def add(self, turn, initial: str, fault: str) -> None:
        count = self.count
        if count["rows"]:
            count["illegal"] += self.initials[1] + initial not in LEGAL
        else:
            self.initials[0] = initial
        self.initials[1] = initial
        count["rows"] += 1
        if turn is not None:
            count["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            count[fault] += 1
        self.kinds.append((initial if initial in ("s", "u", "a") else "-") + (
            "." if not fault else "t" if fault == "truncated" else "x"))

    def row(self, closed: bool) -> dict:
        starts = VERTICES if self.opened else (0,)
        paths = [{"start": s, "end": e, "cost": c, "audit": a, "roles": r}
                 for s in starts for e, (c, a, r) in parse(self.kinds, s).items()]
        return {"conv": self.conv, "part": self.number, **self.count, "opened": self.opened,
                "closed": closed, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "first": self.initials[0], "last": self.initials[1], "paths": paths}


def _pieces(out: pa.Schema):
    """mapInArrow: sorted rows to rows with (part, place) and, behind them, pieces."""
    piece_type = out.field("piece").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        piece = None

        def pieces(rows: list[dict]) -> pa.RecordBatch:
            empty = {n: pa.nulls(len(rows), out.field(n).type) for n in out.names}
            empty["piece"] = pa.array(rows, piece_type)
            return pa.RecordBatch.from_arrays([empty[n] for n in out.names], schema=out)

        for batch in batches:
            parts, places, ended = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "dropped")]
            for conv, turn, initial, fault, dropped in zip(*columns):
                full = piece is not None and len(piece.kinds) >= PIECE_ROWS
                if piece is None or conv != piece.conv or full:
                    if piece is not None:
                        ended.append(piece.row(conv != piece.conv))
                    # The first of a task may go on from the task before.
                    piece = _Piece(conv, number, piece is None or conv == piece.conv)
                    number += 1
                parts.append(piece.number)
                places.append(len(piece.kinds))
                if not dropped:
                    piece.add(turn, initial, fault)
            rows = {"conv": batch.column("conv"), "part": pa.array(parts, pa.int64()),
                    "place": pa.array(places, pa.int64()), "role": batch.column("role"),
                    "text": batch.column("text"), "piece": pa.nulls(len(batch), piece_type)}
            stays = pc.invert(batch.column("dropped"))
            yield pa.RecordBatch.from_arrays([rows[n] for n in out.names], schema=out).filter(stays)
            if ended:
                yield pieces(ended)
        if piece is not None:
            yield pieces([piece.row(False)])

    return run


def _joined(out: pa.Schema):
    """mapInArrow: pieces sorted by conversation to a row per conversation."""

    def finish(conv, total, front, turns):
        cost, audit, roles = min((c + ENDS[v][0], a + ENDS[v][1], r + ENDS[v][2]) for v, (c, a, r) in front.items())
        gaps = turns[1] - turns[0] + 1 - total["turns"] if turns else 0
        return {"conv": conv, "gaps": gaps, **{k: total[k] for k in _COUNTS[1:5]},
                "cost": cost, "audit": audit, "roles": roles}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for p in batch.to_pylist():
                if state is None or state[0] != p["conv"]:
                    if state is not None:
                        done.append(finish(*state[:4]))
                    state = [p["conv"], dict.fromkeys(_COUNTS, 0), {0: (0, "", "")}, None, ""]
                _, total, front, turns, last = state
                for k in _COUNTS:
                    total[k] += p[k]
                if last and p["first"]:
                    total["illegal"] += last + p["first"] not in LEGAL
                if p["first_turn"] is not None:
                    total["turns"] -= turns is not None and turns[1] == p["first_turn"]
                    state[3] = (turns[0] if turns else p["first_turn"], p["last_turn"])
                state[4] = p["last"] or last
                best: dict = {}
                for path in p["paths"]:
                    if path["start"] in front:
                        cost, audit, roles = front[path["start"]]
                        way = (cost + path["cost"], audit + path["audit"], roles + path["roles"])
                        best[path["end"]] = min(best.get(path["end"], way), way)
                state[2] = best
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if state is not None:
            yield pa.RecordBatch.from_pylist([finish(*state[:4])], schema=out)

    return run


_LETTERS = pa.array([chr(c) for c in range(128)])


def _edits(out: pa.Schema):
    """mapInArrow: audits to a row per message that stays or is inserted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, audit = string_buffers(batch.column("audit"))
            begin, roles = string_buffers(batch.column("roles"))
            audit, roles = audit[starts[0]:starts[-1]], roles[begin[0]:begin[-1]]
            starts = starts - starts[0]
            owner = np.repeat(np.arange(len(batch)), np.diff(starts))
            new = audit == ord("I")
            rows = np.concatenate([[0], np.cumsum(~new)])
            at = rows[1:] - 1 - rows[starts[owner]]
            stays = np.nonzero(audit != ord("D"))[0]
            first = np.searchsorted(owner[stays], owner[stays])
            yield pa.RecordBatch.from_arrays([
                batch.column("conv").take(pa.array(owner[stays])), pa.array(np.arange(len(stays)) - first),
                pa.array(at[stays], mask=new[stays]), _LETTERS.take(pa.array(audit[stays])),
                _LETTERS.take(pa.array(roles[stays]))], schema=out)

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", dropped_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation, the repaired messages).

    The first has the id, gaps (turns missing between the least and the largest), blank,
    duplicate, truncated (rows by their first fault: no visible character, role and text seen
    before, no mark of an ended sentence), illegal (neighbouring roles that may not follow each
    other), cost and audit (an initial per edit: Keep, Rerole, Delete, Insert). The second has
    the id, place (from 0), edit, role and text. Rows are taken by turn, null first, then by
    role, the text's first 64 characters and its digest. Null roles and texts count as one blank; rows without an id are a
    conversation of their own. Rows marked in ``dropped_col`` only make their conversation
    known: it has a row even if nothing else is left, with zeros and an empty audit. Empty texts
    are blank. Columns of other names are not looked at; an empty table gives two empty results.
    A conversation's audit is one string, as long as it has rows.
    """
    spark = rows.sparkSession
    conv = StructField("conv", rows.schema[conv_col].dataType)

    def arrow(schema: StructType) -> pa.Schema:
        return spark.createDataFrame([], schema).toArrow().schema

    def blank(name: str):
        return F.coalesce(F.col(f"`{name}`"), F.lit(" "))

    noted = materialize(rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"),
        blank(text_col).alias("text"), (F.coalesce(F.col(f"`{dropped_col}`"), F.lit(False)) if dropped_col
                                        else F.lit(False)).alias("dropped"))
        .withColumn("digest", F.sha2("text", 256)).withColumn("number", F.monotonically_increasing_id()), "messages")
    visible = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "number")
    again = noted.filter(visible & ~F.col("dropped")).groupBy("conv", "role", "digest").agg(
        F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    fault = F.when(~visible, "blank").when(order > F.col("first"), "duplicate").when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    faulty = noted.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                        & (F.col("digest") == F.col("d")), "left").select(
        "conv", "turn", "role", "text", "dropped", F.substring("role", 1, 1).alias("initial"),
        fault.alias("fault"), F.substring("text", 1, 64).alias("begins"), "digest", "number")
    keys = ["conv", "turn", "role", "begins", "digest", "number"]
    long = LongType()
    piece = StructType([
        conv, StructField("part", long), *(StructField(x, long) for x in _COUNTS),
        StructField("opened", BooleanType()), StructField("closed", BooleanType()),
        StructField("first_turn", long), StructField("last_turn", long),
        StructField("first", StringType()), StructField("last", StringType()),
        StructField("paths", ArrayType(_PATH))])
    placed = StructType([conv, StructField("part", long), StructField("place", long),
                         StructField("role", StringType()), StructField("text", StringType()),
                         StructField("piece", piece)])
    tasks = partitions_for(spark, noted.count(), ROWS_PER_TASK)
    both = materialize(faulty.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(
        _pieces(arrow(placed)), placed), "placed-messages")
    messages = both.filter("piece is null").select("conv", "part", "place", "role", "text")
    pieces = both.filter("piece is not null").select("piece.*")

    plan = StructType([conv, *(StructField(x, long) for x in ("gaps", *_COUNTS[1:5], "cost")),
                       StructField("audit", StringType()), StructField("roles", StringType())])
    plans = materialize(pieces.repartition(tasks, "conv").sortWithinPartitions("conv", "part").mapInArrow(
        _joined(arrow(plan)), plan), "repair-plans")

    # Pieces that go on from another: one per task and PIECE_ROWS rows, numbers only.
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.filter("opened or not closed").select(
        F.col("conv").alias("c"), F.col("part").alias("p"), "opened", before.alias("start")).filter(
        "opened and start > 0").select("c", "p", "start")
    whole = messages.join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(
        F.col("conv").alias("c"), (F.col("place") + F.coalesce("start", F.lit(0))).alias("at"), "role", "text")
    edit = StructType([conv, StructField("place", long), StructField("at", long),
                       StructField("edit", StringType()), StructField("initial", StringType())])
    edits = plans.select("conv", "audit", "roles").mapInArrow(_edits(arrow(edit)), edit)
    named = F.when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    repaired = edits.withColumnRenamed("at", "row").join(
        whole, F.col("conv").eqNullSafe(F.col("c")) & (F.col("row") == F.col("at")), "left").select(
        F.col("conv").alias(conv_col), "place", "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(named).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    return plans.drop("roles").withColumnRenamed("conv", conv_col), repaired


def damage(talks: DataFrame) -> DataFrame:
    """Conversations with one row in four spoilt, by the CRC-32 of "conv_id:turn" modulo 20: 0
    marks it ``dropped``, 1 empties its text, 2 takes its marks .!? away, 3 repeats it, 4 makes
    it the user's. Nulls count as one blank, but for ids and turns outside the checksum."""

    def named(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    marked = talks.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("copy", F.explode(times)).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("dropped"))


def repair_digests(plans: DataFrame, repaired: DataFrame) -> DataFrame:
    """The conversations' rows with repaired_sha256, of "role:text" lines of repaired messages."""
    line = F.struct("place", F.concat_ws(":", "role", "text").alias("line"))
    told = repaired.groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_list(line)).alias("lines")).select(
        "c", F.sha2(F.concat_ws("\n", "lines.line"), 256).alias("sha"))
    return plans.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *plans.columns, F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
