import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine
from corpusloom.operators import batch_search, fusion, keyword, postings, ranking, vectors
from corpusloom.operators.postings import PostingsIndex
from corpusloom.plans import bindings, retrieval_queries

VOCAB = ["red", "green", "blue", "cat", "dog", "sun", "moon", "tree", "the", "a"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        kb = "hot" if i % 3 else f"kb{i % 7}"
        text = " ".join(rng.choice(VOCAB[:3 + i % 8]) for _ in range(rng.randint(1, 30)))
        rows.append((kb, f"c{i}", text))
    questions = [(i, "hot" if i % 2 else f"kb{i % 7}",
                  " ".join(rng.choice(VOCAB + ["unknown"]) for _ in range(4)))
                 for i in range(25)] + [(99, "hot", "nothing matches"), (98, "void", "red cat")]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id string, content string")
    asked = spark.createDataFrame(questions, "query_id long, kb_id string, text string")
    stats = keyword.corpus_statistics(chunks)
    return rows, questions, chunks, asked, keyword.term_statistics(chunks, stats), stats


def bm25(rows, questions, k, pad=False):
    out = {}
    for qid, kb, text in questions:
        docs = [(cid, t.split()) for b, cid, t in rows if b == kb]
        if not docs:
            continue
        n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
        df = Counter(w for _, t in docs for w in set(t))
        idf = {w: math.log(n - d + .5) - math.log(d + .5) for w, d in df.items()}
        floor = .25 * sum(idf.values()) / len(idf)
        idf = {w: floor if v < 0 else v for w, v in idf.items()}
        scored = []
        for cid, t in docs:
            tf = Counter(t)
            shared = [w for w in text.split() if tf[w]]
            if shared or pad:
                scored.append((-round(sum(
                    idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (.25 + .75 * len(t) / avg))
                    for w in shared), 6), cid))
        for r, (s, cid) in enumerate(sorted(scored)[:k], 1):
            out[(qid, r)] = (cid, pytest.approx(-s, abs=2e-6))
    return out


def as_map(df, name="chunk_id"):
    return {(r["query_id"], r["rank"]): (r[name], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [64 << 20, 700])
def test_bm25_matches_brute_force(corpus, block_bytes):
    rows, questions, chunks, asked, terms, stats = corpus
    got = keyword.bm25_top_k(chunks, asked, terms, stats, 7, block_bytes=block_bytes)
    assert as_map(got) == bm25(rows, questions, 7)


@pytest.mark.parametrize("unit_chunks, first_units, block_bytes", [(4096, 4, 64 << 20), (7, 1, 700)])
def test_postings_match_brute_force(corpus, unit_chunks, first_units, block_bytes):
    rows, questions, chunks, asked, terms, stats = corpus
    index = PostingsIndex.build(chunks, unit_chunks=unit_chunks)
    options = {"block_bytes": block_bytes, "first_units": first_units}
    assert as_map(index.top_k(asked, terms, stats, 7, **options)) == bm25(rows, questions, 7)
    padded = index.padded_top_k(chunks, asked, terms, stats, 40, **options)
    assert as_map(padded) == bm25(rows, questions, 40, pad=True)


@pytest.mark.parametrize("unit_chunks, block_bytes", [(4096, 64 << 20), (7, 64 << 20), (7, 700)])
def test_many_questions_make_no_row_per_question_and_unit(corpus, monkeypatch, unit_chunks, block_bytes):
    rows, questions, chunks, asked, terms, stats = corpus
    index = PostingsIndex.build(chunks, unit_chunks=unit_chunks)
    monkeypatch.setattr(postings, "SELECTIVE_ASKS", 0, raising=False)
    monkeypatch.setattr(PostingsIndex, "bounds", lambda *_: pytest.fail("a bound for each question and unit"))
    assert as_map(index.top_k(asked, terms, stats, 7, block_bytes=block_bytes)) == bm25(rows, questions, 7)


def test_units_are_full_where_a_task_has_several_kbs(spark, monkeypatch):
    rows = [(f"k{i % 10}", f"c{i}", "word") for i in range(2000)]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id string, content string").coalesce(1)

    def sizes():
        units = PostingsIndex.build(chunks, unit_chunks=100).units()
        return sorted(r[0] for r in units.select(F.size("chunk_ids")).collect())

    assert sizes() == [100] * 20
    monkeypatch.setattr(postings, "HELD_UNITS", 1)
    small = sizes()
    assert sum(small) == 2000 and max(small) <= 100


def test_questions_to_one_kb_share_a_block(spark):
    rows = [(q, f"k{q % 20}", "term", 1.0, 3.0) for q in range(2000)]
    weights = spark.createDataFrame(rows, "query_id long, kb_id string, term string, weight double, avg_len double")
    blocks = [{r.kb_id: r["count"] for r in part.groupBy("kb_id").count().collect()}
              for part in postings._blocks(weights, 250 * 52)]
    assert sum(map(len, blocks)) == 20 and max(map(len, blocks)) == 2
    assert all(n == 100 for part in blocks for n in part.values())
    blocks = [sorted(r.query_id for r in part.collect()) for part in postings._blocks(weights, 30 * 52)]
    assert len(blocks) == 80 and sorted(sum(blocks, [])) == list(range(2000))


def test_postings_of_appended_chunks_and_of_all_kbs(spark, corpus):
    rows, questions, chunks, asked, _, _ = corpus
    index = PostingsIndex.build(chunks.filter("kb_id = 'hot'"), unit_chunks=20)
    index.append(chunks.filter("kb_id <> 'hot'"))
    whole = chunks.withColumn("kb_id", F.lit("all"))
    stats = keyword.corpus_statistics(whole)
    got = index.under("all").top_k(asked.withColumn("kb_id", F.lit("all")),
                                   keyword.term_statistics(whole, stats), stats, 5)
    assert as_map(got) == bm25([("all", c, t) for _, c, t in rows], [(q, "all", t) for q, _, t in questions], 5)
    counted = {(r.kb_id, r.term): (r.df, r.max_tf, r.min_len) for r in index.term_counts().collect()}
    words = [(kb, w, t.split()) for kb, _, t in rows for w in set(t.split())]
    assert counted == {(kb, w): (sum(k == kb and x == w for k, x, _ in words),
                                 max(t.count(w) for k, x, t in words if k == kb and x == w),
                                 min(len(t) for k, x, t in words if k == kb and x == w)) for kb, w, _ in words}


def test_postings_read_the_asked_terms_only(spark):
    chunks = spark.createDataFrame([("k", f"c{i}", f"word{i % 500} filler{i} common") for i in range(3000)],
                                   "kb_id string, chunk_id string, content string")
    index = PostingsIndex.build(chunks, unit_chunks=100)

    def read(terms):
        slots = sorted({r[0] for r in index.postings(terms).select("slot").distinct().collect()})
        rows = index.postings(terms, slots)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "In(term" in plan.replace(" ", "") or "EqualTo(term" in plan.replace(" ", "")
        assert "slot" in plan.split("PartitionFilters")[1].split("]")[0]
        return {r[0] for r in rows.select("term").distinct().collect()}, len(
            {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}), len(slots)

    few, many = read(["word1"]), read([f"word{i}" for i in range(300)])
    assert few[0] == {"word1"} and len(many[0]) == 300
    assert few[1] < many[1] and few[2] == 1 and many[2] > 32


def test_units_that_cannot_reach_the_kth_score_are_left_out(spark):
    rows = [("k", f"c{i:04}", "rare " * (5 if i < 40 else 1) + "pad " * (1 if i < 40 else 60)) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id string, content string").coalesce(1)
    asked = spark.createDataFrame([(1, "k", "rare")], "query_id long, kb_id string, text string")
    weights = spark.createDataFrame([(1, "k", "rare", 2.0, 57.0)],
                                    "query_id long, kb_id string, term string, weight double, avg_len double")
    index = PostingsIndex.build(chunks, unit_chunks=40)
    bounds = index.bounds(weights, index.postings(["rare"]))
    assert bounds.count() == 50
    read = bounds.orderBy(F.desc("bound")).limit(1)
    hits = spark.createDataFrame([(1, 10, 4.0)], "query_id long, rank int, score double")
    assert index.promising(bounds, read, hits, 10).count() == 0
    assert index.promising(bounds, read, hits.withColumn("score", F.lit(0.5)), 10).count() == 49
    chunks = chunks.union(spark.createDataFrame([("k", f"d{i}", f"pad x{i}") for i in range(5000)], chunks.schema))
    index, stats = PostingsIndex.build(chunks, unit_chunks=40), keyword.corpus_statistics(chunks)
    found = index.top_k(asked, keyword.term_statistics(chunks, stats), stats, 10, first_units=1).collect()
    assert [r.chunk_id for r in sorted(found, key=lambda r: r["rank"])] == [f"c{i:04}" for i in range(10)]


def test_bm25_padding_matches_brute_force(corpus):
    rows, questions, chunks, asked, terms, stats = corpus
    got = keyword.bm25_top_k(chunks, asked, terms, stats, 40, pad_zero=True)
    assert as_map(got) == bm25(rows, questions, 40, pad=True)


def test_score_blocks_of_rows_do_not_matter(corpus, monkeypatch):
    from corpusloom.operators import scan
    assert [s for s in scan.row_slices(10, 1_000_000)] == [slice(i, i + 2) for i in range(0, 10, 2)]
    best = scan.BestRows(2, 3)
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 4, (200, 2)).astype(float)
    ids = np.array([f"r{i:03d}" for i in range(200)], dtype=object)
    for at in range(0, 200, 17):
        best.offer(scores[at:at + 17].copy(), ids[at:at + 17], None)
        best.settle()
    held = best.settle()
    for q in (0, 1):
        want = sorted(zip(-scores[:, q], ids))[:3]
        mine = held[held["q"] == q]
        assert list(zip(-mine["score"], mine["row_id"])) == want


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 8)).astype(np.float32)
    data[5] = 0
    data[7] = data[8]
    rows = [("hot" if i % 3 else "cold", f"v{i}", data[i].tolist()) for i in range(400)]
    asked = [(i, "hot" if i % 2 else "cold", rng.normal(size=8).astype(np.float32).tolist())
             for i in range(9)] + [(50, "hot", data[8].tolist()), (51, "cold", [0.0] * 8)]
    return rows, asked, spark.createDataFrame(rows, "kb_id string, chunk_id string, embedding array<float>"), \
        spark.createDataFrame(asked, "query_id long, kb_id string, embedding array<float>")


def nearest(rows, asked, k):
    out = {}
    for qid, kb, q in asked:
        q = np.array(q, dtype=float)
        scored = []
        for b, cid, v in rows:
            if b == kb:
                v = np.array(v, dtype=float)
                size = np.linalg.norm(v) * np.linalg.norm(q)
                scored.append((-round(float(v @ q / size) if size else 0.0, 6), cid))
        for r, (s, cid) in enumerate(sorted(scored)[:k], 1):
            out[(qid, r)] = (cid, pytest.approx(-s, abs=2e-6))
    return out


@pytest.mark.parametrize("block_bytes", [64 << 20, 400])
def test_dense_top_k_matches_brute_force(points, block_bytes):
    rows, asked, table, queries = points
    got = vectors.dense_top_k(table, queries, 6, block_bytes=block_bytes)
    assert as_map(got) == nearest(rows, asked, 6)


def test_cell_index_finds_most_neighbours_and_all_with_all_cells(points):
    rows, asked, table, queries = points
    index = vectors.CellIndex(table, n_cells=6)
    exact = as_map(vectors.dense_top_k(table, queries, 5))
    assert as_map(index.top_k(queries, 5, n_probes=6)) == exact
    near = {(q, c) for (q, _), (c, _) in as_map(index.top_k(queries, 5, n_probes=3)).items()}
    true = {(q, c) for (q, _), (c, _) in exact.items()}
    assert len(near & true) / len(true) > 0.6


def test_cell_index_leaves_out_far_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    homes = rng.normal(size=(40, 16)) * 4
    vecs = [(f"v{i}", (homes[i % 40] + rng.normal(size=16) * 0.3).astype(float).tolist()) for i in range(4000)]
    table = spark.createDataFrame([("k", *v) for v in vecs], "kb_id string, chunk_id string, embedding array<double>")
    queries = table.filter("chunk_id in ('v1', 'v77', 'v3333')").select(
        F.substring("chunk_id", 2, 9).cast("long").alias("query_id"), "kb_id", "embedding")
    index = vectors.CellIndex(table)
    exact = as_map(vectors.dense_top_k(table, queries, 10))
    got = {(q, c) for (q, _), (c, _) in as_map(index.top_k(queries, 10)).items()}
    assert len(got & {(q, c) for (q, _), (c, _) in exact.items()}) >= 0.9 * len(exact)
    asked = np.array([r.embedding for r in queries.orderBy("query_id").collect()])
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    kth = np.array([exact[q, 10][1] for q in (1, 77, 3333)])
    looked = [index.sizes[cells].sum() for cells in index.probes(asked, kth, 10, 0.9)]
    assert max(looked) < 0.2 * index.sizes.sum()


def test_mixed_widths_are_reported_and_refused(spark, points):
    _, _, table, queries = points
    odd = table.unionByName(spark.createDataFrame(
        [("hot", "odd", [1.0, 2.0])], "kb_id string, chunk_id string, embedding array<float>"))
    kbs = spark.createDataFrame([("hot",), ("cold",), ("void",)], "kb_id string")
    report = {r.kb_id: r.compatible for r in vectors.width_report(kbs, odd, 8).collect()}
    assert report == {"hot": False, "cold": True, "void": True}
    with pytest.raises(Exception, match="width_report"):
        vectors.dense_top_k(odd, queries, 3).collect()


def test_cosine_of_a_zero_vector_is_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])],
                                "a array<float>, b array<float>, c array<float>")
    got = row.select(cosine(F.col("a"), F.col("b")), cosine(F.col("b"), F.col("c"))).first()
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0)


def test_vectors_have_unit_length_and_prefer_shared_words(spark):
    texts = spark.createDataFrame(
        [("k", "1", "red cat"), ("k", "2", "blue dog"), ("k", "3", "...")],
        "kb_id string, chunk_id string, content string")
    weights = vectors.slot_weights(texts)
    vecs = vectors.vectorize(texts, weights)
    sizes = {r.chunk_id: sum(x * x for x in r.embedding) for r in vecs.collect()}
    assert sizes["1"] == pytest.approx(1, abs=1e-5) and sizes["3"] == 0
    asked = vectors.vectorize(spark.createDataFrame([(1, "k", "a red thing")],
                              "query_id long, kb_id string, text string"), weights, "text")
    assert vectors.dense_top_k(vecs, asked, 1).first().chunk_id == "1"


def test_top_k_of_a_hot_group_is_exact(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"),
        (F.col("id") * 37 % 101).alias("v"), "id")
    got = ranking.top_k_per_group(rows, ["g"], [F.desc("v"), F.col("id")], 4).collect()
    data = {}
    for r in rows.collect():
        data.setdefault(r.g, []).append((-r.v, r.id))
    want = {(g, i): x[1] for g, xs in data.items() for i, x in enumerate(sorted(xs)[:4], 1)}
    assert {(r.g, r["rank"]): r.id for r in got} == want


HIT = "query_id long, rank int, chunk_id string, content string, source string, page int, type string, image string"


def hit(rank, name, content=None, q=1):
    return (q, rank, f"{name}{rank}", content or name, "s", 0, "text", "")


def test_fusion_adds_duplicates_and_settles_ties(spark):
    same = "x" * 50
    vector = spark.createDataFrame(
        [hit(1, "v", same + "first"), hit(2, "w"), hit(3, "v", same + "last")], HIT)
    words = spark.createDataFrame(
        [hit(1, "k"), hit(2, "w"), hit(3, "v", same + "other"), hit(4, "v", same + "more")], HIT)
    got = fusion.fuse(vector, words, 5, 1.0, 1.0).orderBy("rank").collect()
    assert [r.content for r in got] == [same + "last", "w", "k"]
    assert got[0].rrf_score == pytest.approx(1 / 63 + 1 / 63 + 1 / 64, abs=1e-9)
    plain = fusion.fuse(vector, words, 5).orderBy("rank").collect()
    assert [(r.content, r.rrf_score) for r in plain] == [
        ("w", round(1 / 62, 9)), (same + "last", round(1 / 63, 9)), ("k", 0.0)]


def test_equal_scores_put_vector_hits_first(spark):
    vector = spark.createDataFrame([hit(1, "v"), hit(2, "w")], HIT)
    words = spark.createDataFrame([hit(1, "a"), hit(2, "b")], HIT)
    got = fusion.fuse(vector, words, 4, 1.0, 1.0).orderBy("rank").collect()
    assert [r.content for r in got] == ["v", "a", "w", "b"]


def test_rendering_shows_known_pages_and_a_reply_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, "c1", "y" * 400, "a.md", 3, "text", ""),
                                  (1, 2, "c2", "short", "b.md", 0, "text", "")], HIT)
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.text for r in fusion.render_hits(asked, hits).collect()}
    assert got[1] == "[1] 来源: a.md, 第 3 页\n" + "y" * 300 + "\n\n[2] 来源: b.md\nshort\n"
    assert got[2] == fusion.NOTHING_FOUND


def test_common_terms_are_not_added_place_by_place(monkeypatch):
    n, asks = 500, 200
    table = pa.table({"query_id": list(range(asks)) * 2, "kb_id": ["k"] * 2 * asks, "avg_len": [3.0] * 2 * asks,
                      "term": ["every"] * asks + [f"rare{i}" for i in range(asks)], "weight": [0.5] * asks + [2.0] * asks})
    lists = {"every": (np.arange(n), np.ones(n, np.int64))} | {
        f"rare{i}": (np.array([i]), np.array([2])) for i in range(asks)}
    unit = {"chunk_ids": [f"c{i:03}" for i in range(n)], "lengths": [3] * n, "queries": list(range(asks))}
    added, ragged = [], postings._ragged
    monkeypatch.setattr(postings, "_ragged", lambda *x: added.append(ragged(*x)) or added[-1])
    found = [row for part in postings.best_of_unit(postings.pack_asks(table)["k"], unit, lists, 2, False)
             for row in zip(*part)]
    every, rare = 0.5 * postings.gain(1, 3, 3.0), 2.0 * postings.gain(2, 3, 3.0)
    for q in range(asks):
        other = "c001" if q == 0 else "c000"
        assert [(c, s) for a, c, s in found if a == q] == [
            (f"c{q:03}", pytest.approx(every + rare, abs=1e-6)), (other, pytest.approx(every, abs=1e-6))]
    assert sum(map(len, added)) < 0.1 * n * asks


def test_units_are_full_whatever_the_batches_are(spark):
    chunks = spark.createDataFrame([("k", f"c{i:04}", "a b " * (300 if i == 7 else 1) + f"w{i}") for i in range(200)]
                                   + [("k", "empty", " ")], "kb_id string, chunk_id string, content string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "17")
    try:
        index = postings.PostingsIndex.build(chunks, unit_chunks=40)
    finally:
        spark.conf.set(name, before)
    sizes = sorted(len(r.chunk_ids) for r in index.units().collect())
    assert sizes == [1, 40, 40, 40, 40, 40]
    stored = index.postings(["a", "w3"]).collect()
    # Numbers take the bytes that a unit's largest one needs.
    assert {len(r.places) // r.n for r in stored} == {1}
    assert sorted({len(r.counts) // r.n for r in stored}) == [1, 2]
    assert sum(r.n for r in stored if r.term == "a") == 200 and max(r.max_tf for r in stored) == 300


def test_tokens_that_cannot_travel_as_one_string_are_refused(spark):
    from corpusloom.operators.keyword import with_tokens
    chunks = with_tokens(spark.createDataFrame([("k", "c", "a b")], "kb_id string, chunk_id string, content string"))
    odd = chunks.withColumn("tokens", F.array(F.lit("a\0b"), F.lit("c")))
    with pytest.raises(Exception, match="holds the character 0"):
        postings.PostingsIndex.build(odd)


def test_sparse_vectors_hold_what_is_not_zero(spark):
    texts = spark.createDataFrame([("k", "a", "one two two"), ("k", "b", "..."), ("k", "c", "three one"), ("x", "d", "one")],
                                  "kb_id string, chunk_id string, content string")
    weights = vectors.slot_weights(texts.filter("kb_id = 'k'"))
    dense = {r.chunk_id: r.embedding for r in vectors.vectorize(texts, weights).collect()}
    sparse = {r.chunk_id: [tuple(x) for x in r.embedding] for r in vectors.vectorize(texts, weights, sparse=True).collect()}
    assert sparse == {c: [(i, w) for i, w in enumerate(v) if w] for c, v in dense.items()}
    assert set(sparse) == {"a", "b", "c"} and sparse["b"] == []


@pytest.mark.parametrize("unit_chunks, block_bytes", [(4096, 64 << 20), (7, 64 << 20), (4096, 9000)])
def test_batch_search_matches_brute_force_and_stored_vectors(corpus, monkeypatch, unit_chunks, block_bytes):
    rows, questions, chunks, asked, terms, stats = corpus
    monkeypatch.setattr(batch_search, "UNIT_CHUNKS", unit_chunks)
    slots = vectors.slot_weights(chunks)
    found = batch_search.batch_top_k(chunks, asked, batch_search.Statistics(slots, terms, stats), 7, block_bytes)
    found.cache()
    assert as_map(found.filter("side = 'k'")) == bm25(rows, questions, 7)
    near = vectors.dense_top_k(vectors.vectorize(chunks, slots),
                               vectors.vectorize(asked, slots, "text"), 7)
    assert as_map(found.filter("side = 'v'")) == as_map(near)
    found.unpersist()
    one = batch_search.batch_top_k(chunks, asked, batch_search.Statistics(slots), 7, block_bytes)
    assert {r.side for r in one.collect()} == {"v"}


def test_batch_search_takes_text_ids_unknown_kbs_and_texts_without_tokens(spark):
    chunks = spark.createDataFrame([("k", "a", "..."), ("k", "b", "red cat"), ("k", "c", "blue dog"), ("k", "d", "sun")],
                                   "kb_id string, chunk_id string, content string")
    asked = spark.createDataFrame([("one", "k", "red"), ("two", "void", "red"), ("three", "k", "...")],
                                  "query_id string, kb_id string, text string")
    stats = keyword.corpus_statistics(chunks)
    known = batch_search.Statistics(vectors.slot_weights(chunks), keyword.term_statistics(chunks, stats), stats)
    found = batch_search.batch_top_k(chunks, asked, known, 2).collect()
    assert {(r.query_id, r.rank): r.chunk_id for r in found if r.side == "k"} == {("one", 1): "b"}
    assert {(r.query_id, r.rank): r.chunk_id for r in found if r.side == "v"} == {
        ("one", 1): "b", ("one", 2): "a", ("three", 1): "a", ("three", 2): "b"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_one_batch_of_questions_builds_no_index_and_stores_no_vectors(spark, monkeypatch):
    stored = []

    def noted(module):
        make = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, *a: stored.append((name, df.columns)) or make(df, name, *a))

    for module in (bindings, batch_search, retrieval_queries):
        noted(module)
    monkeypatch.setattr(bindings, "_built", {})
    monkeypatch.setattr(PostingsIndex, "build", lambda *_: pytest.fail("an index for one batch of questions"))
    assert retrieval_queries.answer_questions(spark, "/root/testdata/sf0.001").count() > 0
    assert "chunks" in {name for name, _ in stored}
    assert not [name for name, columns in stored if {"chunk_id", "embedding"} <= set(columns)]


def test_one_pass_counts_what_the_single_passes_count(corpus):
    rows, questions, chunks, asked, terms, stats = corpus
    known = batch_search.count_all(chunks)
    assert sorted(known.corpus.collect()) == sorted(stats.collect())

    def weights(df):
        return {(r.kb_id, r.term): (r.df, pytest.approx(r.idf, abs=1e-12)) for r in df.collect()}

    assert weights(known.terms) == weights(terms)
    assert sorted(known.slots.collect()) == sorted(vectors.slot_weights(chunks).collect())


@pytest.mark.parametrize("unit_chunks, block_bytes", [(4096, 64 << 20), (7, 700)])
def test_units_alone_answer_and_count_as_the_whole_index_does(corpus, unit_chunks, block_bytes):
    rows, questions, chunks, asked, terms, stats = corpus
    index = PostingsIndex.build(chunks, unit_chunks=unit_chunks, by_term=False)
    assert index.postings().count() == 0
    assert as_map(index.top_k(asked, terms, stats, 7, block_bytes=block_bytes)) == bm25(rows, questions, 7)
    padded = index.padded_top_k(chunks, asked, terms, stats, 40, block_bytes=block_bytes)
    assert as_map(padded) == bm25(rows, questions, 40, pad=True)
    counted, known = index.statistics()
    assert sorted(known.collect()) == sorted(stats.collect())
    assert {(r.kb_id, r.term): (r.df, r.idf) for r in counted.collect()} == {
        (r.kb_id, r.term): (r.df, pytest.approx(r.idf, abs=1e-12)) for r in terms.collect()}


def test_terms_are_counted_however_few_a_task_holds(corpus, monkeypatch):
    rows, questions, chunks, asked, terms, stats = corpus
    index = PostingsIndex.build(chunks, unit_chunks=7, by_term=False)
    monkeypatch.setattr(postings, "COUNTED_TERMS", 9)
    kind = postings._lists_schema()
    out = pa.schema([("kb_id", pa.string()), ("term", pa.string()), ("df", pa.int64())])
    told = Counter()
    for part in postings._term_counts(kind, out)(iter(index.units().select("kb_id", "lists").toArrow().to_batches())):
        for kb, term, df in zip(*(c.to_pylist() for c in part.columns)):
            told[kb, term] += df
    assert told == {(r.kb_id, r.term): r.df for r in terms.collect()}


@pytest.mark.parametrize("query", ["first_sources", "bm25_padded"])
def test_user_questions_build_no_lists_by_term(spark, monkeypatch, query):
    monkeypatch.setattr(bindings, "_built", {})
    monkeypatch.setattr(postings, "_unpacked", lambda *_: pytest.fail("rows by term for questions that read all units"))
    assert retrieval_queries.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0


def test_scores_added_up_in_half_the_bytes_are_exact_in_the_end():
    rng = np.random.default_rng(3)
    n, asks, terms, k = 600, 70, 40, 5
    lists = {f"t{t}": np.sort(rng.choice(n, rng.integers(1, n), replace=False)) for t in range(terms)}
    lists = {t: (places, rng.integers(1, 9, len(places))) for t, places in lists.items()}
    lengths = rng.integers(5, 90, n)
    asked = [(q, t, float(w)) for q in range(asks) for t, w in zip(
        rng.choice(terms, 12, replace=False), rng.random(12) * 10.0 ** rng.integers(-3, 3))]
    table = pa.table({"query_id": [q for q, _, _ in asked], "kb_id": ["k"] * len(asked), "avg_len": [40.0] * len(asked),
                      "term": [f"t{t}" for _, t, _ in asked], "weight": [w for _, _, w in asked]})
    unit = {"chunk_ids": [f"c{i:03}" for i in range(n)], "lengths": lengths.tolist(), "queries": list(range(asks))}
    got = {q: [] for q in range(asks)}
    for part in postings.best_of_unit(postings.pack_asks(table)["k"], unit, lists, k, False):
        for q, c, s in zip(*part):
            got[q].append((-s, c))
    for q in range(asks):
        scores = np.zeros(n)
        for p, t, w in asked:
            if p == q:
                places, counts = lists[f"t{t}"]
                scores[places] += w * postings.gain(counts, lengths[places], 40.0)
        best = sorted((-round(s, 6), f"c{i:03}") for i, s in enumerate(scores) if s > 0)[:k]
        assert [c for _, c in got[q]] == [c for _, c in best]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in best], abs=2e-6)


@pytest.mark.parametrize("by_term", [True, False])
def test_an_id_that_asks_two_kbs_has_one_list_however_many_blocks_there_are(spark, by_term):
    chunks = spark.createDataFrame([(kb, f"{kb}{i}", f"red {'cat ' * i}") for kb in ("k1", "k2") for i in range(6)]
                                   + [(kb, f"{kb}x{i}", "sun") for kb in ("k1", "k2") for i in range(9)],
                                   "kb_id string, chunk_id string, content string")
    asked = spark.createDataFrame([(1, "k1", "red cat"), (1, "k2", "cat"), (2, "k2", "red")],
                                  "query_id long, kb_id string, text string")
    stats = keyword.corpus_statistics(chunks)
    terms = keyword.term_statistics(chunks, stats)
    index = PostingsIndex.build(chunks, by_term=by_term)
    whole, parts = (as_map(index.top_k(asked, terms, stats, 3, block_bytes=size)) for size in (64 << 20, 110))
    assert parts == whole and sorted(parts) == [(q, r) for q in (1, 2) for r in (1, 2, 3)]
