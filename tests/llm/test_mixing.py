"""Mixing against plain Python: targets by resharing in rounds, samples by sorted keys."""

import hashlib
import math
import random
import re

import pytest

from corpusloom.llm import mixing
from corpusloom.llm.mixing import apply_mix, mix


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def weight_of(text):
    text = text or ""
    return max(0.05, 1 - 3 * (sum(c in "#$%&*|!" for c in text) / max(1, len(text))))


def brute(rows):
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size_of(t) for _, t, o in rows if o == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    wanted, target, free = 1.5 * sum(sizes.values()), {}, list(sources)
    while free:
        level = (wanted - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        free = [s for s in free if s not in over]
    out = []
    for s in sources:
        own = []
        for d, t, o in rows:
            if o == s:
                digest = hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
                u = (int(digest[:12], 16) + 0.5) / 2 ** 48
                own.append((-math.log(u) / weight_of(t), d is not None, d or 0, size_of(t), d))
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = math.floor(target[s]) - epochs * sizes[s]
        for *_, size, d in sorted(own, key=lambda x: x[:4]):
            part = max(0, min(size, rest))
            rest -= part
            out.append((d, size, sizes[s], round(target[s], 6), epochs * size + part))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ", None), (None, "no id here", "c"), (4, "only", "lone"),
            (5, "dup dup", "d"), (5, "dup dup", "d")]
    for i in range(700):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "s1", "s2", "é", "Z", "z"])
        words = rng.choices(["w", "mot", "##", "|", "x!"], [9, 9, 1, 1, 1], k=rng.choice([1, 3, 20, 90]))
        rows.append((10 + i, " ".join(words), source))
    rows.append((5000, "huge " * 20_000, "big"))
    return rows


@pytest.mark.parametrize("per_bucket", [2000, 10])
def test_mix_matches_plain_python(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_bucket)
    rows = corpus(per_bucket)
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows],
                               "doc_id long, text string, source string, size int, key double").repartition(4)
    got = mix(df).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got),
                  key=repr) == brute(rows)
    assert all(r.taken <= 2 * r.size for r in got)


def test_empty_table_and_odd_weights(spark):
    df = spark.createDataFrame([(i, "a b c d", "s", w) for i, w in enumerate([None, -1.0, 0.0, float("nan"), 2.0])],
                               "doc_id long, text string, source string, w double")
    assert mix(df.limit(0)).count() == 0
    rows = mix(df, quality=df["w"]).collect()
    assert sum(r.taken for r in rows) == 30 and {r.taken for r in rows} <= {4, 6, 8}


def test_apply_mix_copies_and_cuts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc d", 7), (2, "e f", 8), (3, "g", 9), (4, None, 9)],
                                 "doc_id long, text string, size int")
    taken = spark.createDataFrame([(1, 4, 6), (2, 2, 4), (3, 1, 0), (4, 0, 0)],
                                  "doc_id long, size long, taken long")
    got = sorted(tuple(r) for r in apply_mix(docs, taken).collect())
    assert got == [(1, "a  b\nc d", 7), (1, "a b", 7), (2, "e f", 8), (2, "e f", 8)]


def test_rows_without_an_id_are_copied(spark):
    docs = spark.createDataFrame([(None, "a b c", "s"), (1, "d e f", "s")], "doc_id long, text string, source string")
    taken = spark.createDataFrame([(None, 3, 6), (1, 3, 2)], "doc_id long, size long, taken long")
    got = sorted((r.doc_id is None, r.text) for r in apply_mix(docs, taken).collect())
    assert got == [(False, "d e"), (True, "a b c"), (True, "a b c")]
