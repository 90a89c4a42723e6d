"""Conversation repair against brute force, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import dialogue_repair as dr

SOUND = re.compile(r"(s?(ua)+)?")


def cheapest(kinds):
    """All edit scripts with up to two inserts in a place."""
    def options(kind):
        initial, fault = kind
        yield 4, "D", ""
        if fault != "x":
            more = 3 * (fault == "t")
            yield more, "K", initial
            yield 3 + more, "R", "u"
            yield 3 + more, "R", "a"

    inserts = [(3 * len(x), "I" * len(x), "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    steps = [[(c + d, a + b, r + s) for c, a, r in inserts for d, b, s in options(kind)] for kind in kinds]
    best = None
    for script in itertools.product(*steps, inserts):
        cost = sum(x[0] for x in script)
        audit, roles = ("".join(x[i] for x in script) for i in (1, 2))
        if SOUND.fullmatch(roles) and (best is None or (cost, audit) < best):
            best = cost, audit
    return best


def total(kinds):
    return min((c + dr.ENDS[v][0], a + dr.ENDS[v][1]) for v, (c, a, _) in dr.parse(kinds).items())


def test_the_automaton_accepts_sound_dialogues_only():
    stacks = dr.Stacks(dr.Automaton(dr.RULES))
    for n in range(8):
        for word in itertools.product("sua", repeat=n):
            vertex = 0
            for terminal in word:
                vertex = None if vertex is None else stacks.advance(vertex, terminal)
            assert (vertex is not None and stacks.accepts(vertex)) == bool(SOUND.fullmatch("".join(word)))


def test_short_conversations():
    kinds = [i + f for i in "sua-" for f in ".tx"]
    for n in range(3):
        for word in itertools.product(kinds, repeat=n):
            assert total(list(word)) == cheapest(list(word))
    rng = random.Random(1)
    for _ in range(60):
        word = [rng.choice(kinds) for _ in range(3)]
        assert total(word) == cheapest(word)


def by_rows(kinds):
    """The same by the four states of the language, audits written out."""
    insert = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def close(front):
        for _ in range(4):
            for q, (c, a, r) in list(front.items()):
                to, role = insert[q]
                front[to] = min(front.get(to, (10 ** 9, "", "")), (c + 3, a + "I", r + role))
        return front

    front = close({0: (0, "", "")})
    for initial, fault in kinds:
        new = {}

        def put(q, way):
            new[q] = min(new.get(q, (10 ** 9, "", "")), way)

        for q, (c, a, r) in front.items():
            put(q, (c + 4, a + "D", r + "-"))
            if fault != "x":
                more = 3 * (fault == "t")
                to, role = insert[q]
                put(to, (c + 3 + more, a + "R", r + role))
                if (q, initial) in keep:
                    put(keep[q, initial], (c + more, a + "K", r + initial))
        front = close(new)
    return min(front[q] for q in (0, 3) if q in front)


def brute(rows):
    """Of undamaged rows (conv, turn, role, text), as ``repair_digests`` gives it."""
    talks = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = talks.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in talks.items():
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2][:64], hashlib.sha256(m[2].encode()).hexdigest()))
        kinds, count, seen = [], {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for turn, role, text in mine:
            seen_text = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not seen_text else "duplicate" if (role, text) in seen else (
                "truncated" if seen_text[-1] not in ".!?" else "")
            seen.add((role, text))
            if fault:
                count[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "-"
            kinds.append(initial + {"": ".", "truncated": "t"}.get(fault, "x"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [m[0] for m in mine if m[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles = by_rows(kinds)
        lines, left = [], iter(mine)
        for edit, role in zip(audit, roles):
            row = next(left) if edit != "I" else (None, "", "")
            if edit != "D":
                name = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[role]
                lines.append(f"{name}:{row[2]}")
        out.append((conv, gaps, *count.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_long_conversations_by_rows():
    rng = random.Random(2)
    kinds = [i + f for i in "sua-" for f in "...tx"]
    for n in (5, 40, 300):
        for _ in range(20):
            word = [rng.choice(kinds) for _ in range(n)]
            assert total(word) == by_rows(word)[:2]


@pytest.mark.parametrize("piece", [20_000, 7])
def test_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(dr, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    texts = ["Yes.", "No!", "Why", "", " \n", None, "Ja.\n", "é", "Long. " * 3000, "A. B", "same?"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randrange(1, 9)):
            if rng.random() < 0.9:
                rows.append((conv, rng.choice([turn, turn, turn, None, turn + 40]), rng.choice(roles), rng.choice(texts)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2000)] + [(1001, 3, "user", "x.")] * 50
    df = spark.createDataFrame([(*r, 1, "z") for r in rows],
                               "conv_id long, turn long, role string, text string, place int, edit string").repartition(5)
    found = dr.repair_digests(*dr.repair(dr.damage(df), dropped_col="dropped")).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)


def test_other_names_and_empty_tables(spark):
    df = spark.createDataFrame([("k", 1, "assistant", "Hi.")], "talk string, at int, who string, said string")
    plans, messages = dr.repair(df, "talk", "at", "who", "said")
    assert [tuple(r) for r in plans.collect()] == [("k", 0, 0, 0, 0, 0, 3, "IK")]
    assert sorted(tuple(r) for r in messages.collect()) == [("k", 0, "I", "user", ""), ("k", 1, "K", "assistant", "Hi.")]
    plans, messages = dr.repair(df.limit(0), "talk", "at", "who", "said")
    assert plans.count() == messages.count() == 0
