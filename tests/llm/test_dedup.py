"""Exact and near duplicates against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import near_dedup
from corpusloom.llm.common import shingle_sets
from corpusloom.llm.components import connected_components
from corpusloom.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode

SPACE = r"[\x20\x09-\x0D]+"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), np.int64)
    k, unary, payload = golomb_encode(values, (1 << 40) + 1)
    assert np.array_equal(golomb_decode(len(values), k, unary, payload), values)


ROWS = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " "), (6, "\n\n"), (7, "x" * 50_000),
        (8, "x" * 50_000), (None, "a b\nc"), (None, "only"), (9, "twice"), (9, "twice"), (10, "A b c"),
        (11, "a\xa0b c")] + [(100 + i, "hot text") for i in range(40)]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(i, t, i, t) for i, t in ROWS],
                               "doc_id long, text string, keep long, sha string").repartition(5)
    norm = [re.sub(SPACE, " ", t or "") for _, t in ROWS]
    want = []
    for (i, _), t in zip(ROWS, norm):
        ids = [j for (j, _), s in zip(ROWS, norm) if s == t]
        keep = min([j for j in ids if j is not None], default=i)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_duplicates(df.limit(0)).count() == 0


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    size = min(width, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\xa0", max_size=30), max_size=8), st.integers(1, 5))
def test_shingle_sets(texts, width):
    found = []
    for row, bounds, hashes in shingle_sets(pa.array(texts, pa.string()), width):
        assert row == len(found)
        found += [tuple(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    want = [sets_of(t, width) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(set(found[i]) & set(found[j])) == len(want[i] & want[j])


def brute(rows, width):
    sets = [sets_of(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            label[root(i)] = root(first.setdefault(doc_id, i))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)), d is not None and d == least.get(root(i)))
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus():
    rng = random.Random(5)
    rows, at = [(None, "no id at all"), (1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "two words")], 10
    for size in (6, 25, 60, 400):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(30):
            for _ in range(rng.randrange(0, 1 + size // 16)):
                base[rng.randrange(size)] = f"v{rng.randrange(400)}"
            rows.append((at, " ".join(base)))
            at += rng.randrange(1, 3)
    rows += [(at + i, " ".join(f"u{rng.randrange(3000)}" for _ in range(50))) for i in range(40)]
    rows.append((at + 50, rows[10][1]))
    rows.append((at + 50, rows[10][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, block", [(2, 250_000), (2, 500), (5, 250_000)])
def test_near_duplicates(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows],
                               "doc_id long, text string, n int, class int").repartition(4)
    got = near_dedup.near_duplicates(df, width=width).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width)


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rng = random.Random(9)

    def near(text):
        words = text.split()
        words[rng.randrange(60)] = "changed"
        return " ".join(words)

    one, two, three, four, five = (" ".join(f"q{rng.randrange(9000)}" for _ in range(60)) for _ in range(5))
    rows = [(10, one), (10, two), (11, near(one)), (12, near(two)), (5, three), (None, near(three)), (None, near(near(three))),
            (None, four), (None, four), (None, near(four)), (20, ""), (20, five), (19, near(five)), (30, None), (30, " "),
            (40, one), (41, "x"), (41, "y"), (42, "y"), *[(None, "hot " * 70)] * 40, (50, "hot " * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dedup.near_duplicates(df, width=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_near_duplicates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0


def test_likelihood_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(60):
        shared, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(
            0, 1 << 63, 200, dtype=np.uint64)
        pairs.append((np.concatenate([shared, own[:100]]), np.concatenate([shared, own[100:]])))
    flat = [x for p in pairs for x in p]
    bounds = np.cumsum([0] + [len(x) for x in flat])
    regs = near_dedup.registers(bounds, np.concatenate(flat))
    n = np.full(len(pairs), 900)
    assert near_dedup.plausible(regs[::2], regs[1::2], n, n, 0.8).all()
    assert not near_dedup.plausible(regs[::2], np.roll(regs[1::2], 1, 0), n, n, 0.8).any()


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(80)]
    rng.shuffle(links)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in links],
                               "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {}
    for a, b in sorted(tuple(sorted(x)) for x in links):
        want[b] = want.setdefault(a, a) if a in want else a
        want.setdefault(a, a)
    assert got == {n: c for n, c in want.items() if n in got} and len(got) >= len(want) - 1
