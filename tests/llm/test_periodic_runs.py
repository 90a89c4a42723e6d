"""Runs of words against brute force, Lyndon arrays against their definition."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import periodic_runs as pr


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_lyndon_array(text):
    def lyndon(w):
        return all(w < w[i:] for i in range(1, len(w)))

    want = [max(k for k in range(1, len(text) - i + 1) if lyndon(text[i:i + k])) for i in range(len(text))]
    assert pr.lyndon_array(text) == want


def brute(words):
    """All maximal stretches, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs(parts):
    words = np.array([w for part, times in parts for w in part * times], np.int64)
    assert [tuple(r) for r in pr.runs_of(words).tolist()] == brute(words.tolist())


def thue_morse(k):
    return [bin(i).count("1") % 2 for i in range(1 << k)]


def test_equal_hashes_of_different_words():
    """Thue-Morse words, on which sums of powers modulo 2**64 agree."""
    a = thue_morse(11)
    b = [1 - x for x in a]
    words = np.array([5, *a, *b, *a, *b, 6] + [7] * 9 + [*b, *a] * 4, np.int64)
    assert [tuple(r) for r in pr.runs_of(words).tolist()] == brute(words.tolist())


def digest(doc, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


@pytest.mark.parametrize("size", [2 << 20, 200])
def test_documents(spark, monkeypatch, size):
    monkeypatch.setattr(pr, "SLICE_BYTES", size)
    prose = "one two three four\tfive six\nseven eight\x0bnine ten é\xa0x "
    docs = [(i, prose * (i % 7) + "a b " * (i % 5) + "end") for i in range(120)]
    docs += [(None, "x " * 9), (None, None), (7, ""), (7, "y y y y y y"), (8, "y y y y y"), (9, "\x85 " * 6),
             (300, "long " * 30_000), (301, " ".join(map(str, range(20_000))) + " a b c" * 5 + " a")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, runs int, words string")
    found = pr.run_digests(pr.periodic_runs(pr.repeat_tails(df.repartition(3))))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((digest(*d) for d in docs), key=repr)
    assert pr.run_digests(pr.periodic_runs(pr.repeat_tails(df.limit(0)))).count() == 0


def test_runs_and_text_of_any_table(spark):
    df = spark.createDataFrame([("k", "z a b a b a b a b c")], "name string, body string")
    row = pr.periodic_runs(df, "name", "body").first()
    assert (row.name, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 10, [(1, 8, 2)], "z a b c")
