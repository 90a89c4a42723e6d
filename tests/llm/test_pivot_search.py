"""Exact top-k against brute force, with odd rows."""

import math
import random

import numpy as np

from corpusloom.llm import pivot_search
from corpusloom.llm.pivot_search import top_inner_products


def brute(rows, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (width - len(v))) for i, v in fine]
    out = []
    for q in sorted({i for i, _ in fine if i % 100 == 0}):
        own = next(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows],
                               "vec_id long, embedding array<double>, score int").repartition(3)
    return sorted(map(tuple, top_inner_products(df).collect()))


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "RING_ROWS", 16)
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centre)]) for i in range(600)]
    rows += [(600 + i, list(centre[0])) for i in range(250)]
    rows += [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8),
             (None, [1.0] * 8), (1300, [0.5]), (1301, []), (1302, [3.0] * 8), (1302, [3.0] * 8)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_components_and_small_tables(spark):
    rows = [(0, [1e6, -1e6]), (1, [2e6, 1.0]), (100, [3e6, 7e5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(100, [1.0])]) == []


def test_rings_are_left_out(spark):
    rng = np.random.default_rng(0)
    pivots = np.eye(8) * 1000
    vectors = pivots[rng.integers(0, 8, 400)] + rng.normal(0, 10, (400, 8))
    far = np.sqrt(pivot_search.squared_distances(vectors, pivots))
    own = far.argmin(1)
    query, away = vectors[0], far[0]
    limit = np.sort(vectors @ query)[-10]
    ring = [own == c for c in range(8)]
    bound = [(query @ query + (vectors[r] ** 2).sum(1).max() - max(
        0, far[r, c].min() - away[c], away[c] - far[r, c].max()) ** 2) / 2 for c, r in enumerate(ring)]
    assert all(b >= (vectors[r] @ query).max() for b, r in zip(bound, ring))
    assert sum(b >= limit for b in bound) == 1


def test_rings_are_expanded_in_order_until_the_limit():
    rng = np.random.default_rng(2)
    pivots = rng.normal(0, 400, (30, 16)).round()
    vectors = (pivots[np.repeat(np.arange(30), 100)] + rng.normal(0, 20, (3000, 16))).round().astype(np.int32)
    ids = np.arange(3000)
    rings = []
    for c in range(30):
        own = np.arange(c * 100, c * 100 + 100)
        far = np.sqrt(pivot_search.squared_distances(vectors[own].astype(float), pivots[c:c + 1]))[:, 0]
        own, far = own[np.argsort(far)], np.sort(far)
        for at in range(0, 100, 25):
            part = own[at:at + 25]
            rings.append(pivot_search.Ring(c, far[at], far[at + 24], float(np.sqrt((vectors[part].astype(float) ** 2).sum(1).max())),
                                           ids[part], vectors[part]))
    asked = vectors[::100]
    answers = pivot_search.Answers(ids[::100], np.full(30, np.iinfo(np.int64).min), np.full(30, np.iinfo(np.int64).max), 10)
    rng.shuffle(rings)
    looked = pivot_search.expand(answers, asked, pivots, rings)
    q, s, v = answers.settle()
    for i in range(30):
        scores = vectors.astype(np.int64) @ asked[i].astype(np.int64)
        best = [x for x in np.lexsort((ids, -scores)) if x != i * 100][:10]
        assert v[q == i].tolist() == best and s[q == i].tolist() == scores[best].tolist()
    assert 30 <= looked < 0.5 * 30 * len(rings)


def test_most_rows_are_queries(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK_BYTES", 2000)
    monkeypatch.setattr(pivot_search, "HELD_RINGS", 2)
    monkeypatch.setattr(pivot_search, "RING_ROWS", 16)
    rng = random.Random(4)
    rows = [(100 * i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(7, [1.0] * 6)]
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast",
                        lambda self, value: (sent.append(len(value[0])) if isinstance(value, tuple) else None, broadcast(value))[1])
    assert run(spark, rows) == brute(rows)
    assert sum(sent) == 150 and max(sent) <= 100
