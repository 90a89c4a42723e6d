import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer_cache as cache, context

HIT = "query_id long, rank int, content string, source string, page int, type string, image string"


def hits(spark, *rows):
    return spark.createDataFrame([(1, i, f"text {i}", *r) for i, r in enumerate(rows, 1)], HIT)


@pytest.fixture(scope="module")
def three(spark):
    return hits(spark, ("tides.txt", 4, "text", ""), ("moon.pdf", 9, "text", ""),
                ("coast.jpg", 0, "image", "/coast.jpg"), ("tides.txt", 7, "text", ""))


def cited(spark, answer, rows):
    answers = spark.createDataFrame([(1, answer)], "query_id long, answer string")
    got = context.cited_sources(answers, rows).orderBy("position").collect()
    return [(r.source, r.page, r.type) for r in got]


def test_marks_map_to_sources_once_in_order(spark, three):
    got = cited(spark, "first [2], then [1][2] and [2]", three)
    assert got == [("moon.pdf", 9, "text"), ("tides.txt", 4, "text")]
    assert [s for s, _, _ in cited(spark, "[3] [1] [7]", three)] == ["coast.jpg", "tides.txt"]


@pytest.mark.parametrize("answer", ["[8]", "[x] [1", "nothing cited", None, "[0]", "[99999999999]"])
def test_marks_that_name_no_hit_are_ignored(spark, three, answer):
    assert cited(spark, answer, three) == []


def test_leading_zeros_count_and_no_hits_is_safe(spark, three):
    assert cited(spark, "[01]", three)[0][0] == "tides.txt"
    assert cited(spark, "[1]", three.limit(0)) == []


def test_history_counts_before_filtering(spark):
    rows = [(1, 5 * i, "assistant" if i % 3 else "user", f"said {i}") for i in range(11)]
    rows += [(2, 0, "system", "no"), (2, 1, "user", "   "), (2, 2, "user", " yes ")]
    rows += [(3, i, "system" if i > 3 else "user", str(i)) for i in range(8)]
    got = context.history_window(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, content string")).collect()
    by = {c: [r.content for r in sorted(got, key=lambda r: r.turn) if r.conv_id == c]
          for c in (1, 2, 3)}
    assert by == {1: [f"said {i}" for i in range(5, 11)], 2: ["yes"], 3: ["2", "3"]}


def test_prompt_holds_system_history_context_and_question(spark, three):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, text string")
    history = spark.createDataFrame(
        [(1, 4, "user", "first"), (1, 5, "assistant", "reply")],
        "query_id long, turn long, role string, content string")
    extra = spark.createDataFrame([(1, "vision", "seen")],
                                  "query_id long, source string, content string")
    got = {r.query_id: r for r in context.build_prompts(
        asked, three, history, "sys in C:/dir", extra).collect()}
    assert [m.role for m in got[1].messages] == ["system", "user", "assistant", "user"]
    assert got[1].messages[0].content == "sys in C:/dir"
    assert got[1].messages[-1].content == got[1].prompt
    assert got[1].prompt.startswith(
        "参考文档：\n\n[文档 1] 来源: tides.txt, 第4页\ntext 1\n\n---\n\n[文档 2] 来源: moon.pdf, 第9页\n")
    assert "[文档 3] 来源: coast.jpg\ntext 3" in got[1].prompt
    assert "[文档 5] 来源: vision\nseen\n\n问题：why?" in got[1].prompt
    assert got[2].reply == context.NO_CONTEXT and got[2].messages is None and got[2].n_hits == 0


def test_sources_and_images_keep_first_occurrence(spark, three):
    got = context.first_per_source(three).orderBy("position").collect()
    assert [(r.source, r.page) for r in got] == [("tides.txt", 4), ("moon.pdf", 9), ("coast.jpg", 0)]
    more = hits(spark, ("x", 0, "image", "/2"), ("x", 0, "image", "/1"), ("x", 0, "text", "/9"),
                ("x", 0, "image", ""), ("x", 0, "image", "/2"))
    assert context.image_paths(more).first().images == ["/2", "/1"]


CACHE = "kb_id string, seq long, question string, embedding array<double>, answer string"
ASK = "query_id long, kb_id string, embedding array<double>"


def look(spark, rows, asked, **kw):
    got = cache.lookup(spark.createDataFrame(rows, CACHE), spark.createDataFrame(asked, ASK), **kw)
    return {r.query_id: (r.answer if r.hit else None) for r in got.collect()}


def test_same_and_similar_questions_hit_others_miss(spark):
    rows = [("n", 1, "q", [3.0, 4.0], "N"), ("s", 1, "q", [-4.0, 3.0], "S")]
    asked = [(1, "n", [6.0, 8.0]), (2, "n", [3.2, 3.9]), (3, "n", [4.0, -3.0]), (4, "s", [3.0, 4.0]),
             (5, "w", [3.0, 4.0]), (6, "s", [0.0, 0.0])]
    assert look(spark, rows, asked) == {1: "N", 2: "N", 3: None, 4: None, 5: None, 6: None}


def test_best_match_wins_and_later_row_on_ties(spark):
    rows = [("k", 1, "q", [1.0, 0.0], "old"), ("k", 2, "q", [2.0, 0.0], "new"),
            ("k", 3, "q", [0.95, 0.3], "near")]
    assert look(spark, rows, [(1, "k", [1.0, 0.0])]) == {1: "new"}


def test_insert_skips_empty_answers_and_evicts_the_oldest(spark):
    rows = [("k", i, "q", [1.0, 0.0], f"A{i}") for i in range(1, 4)] + [("k", 4, "q", [1.0, 0.0], "")]
    table = spark.createDataFrame(rows, CACHE)
    kept = cache.insert(table.limit(0), table, capacity=2)
    assert sorted(r.seq for r in kept.collect()) == [2, 3]
    assert cache.insert(table.limit(0), table, enabled=False).count() == 0
    many = spark.range(201).select(F.lit("k").alias("kb_id"), F.col("id").alias("seq"))
    assert cache.evict(many).agg(F.min("seq"), F.count("*")).first() == (1, 200)


def test_invalidation_clears_only_changed_kbs(spark):
    rows = [("kb1", 1, "q", [1.0], "A"), ("kb2", 1, "q", [1.0], "B")]
    left = cache.invalidate(spark.createDataFrame(rows, CACHE),
                            spark.createDataFrame([("kb1",)], "kb_id string"))
    assert [r.answer for r in left.collect()] == ["B"]


def test_questions_with_history_bypass_the_cache(spark):
    table = spark.createDataFrame([("k", 1, "q", [1.0, 0.0], "A")], CACHE)
    asked = spark.createDataFrame(
        [(1, "k", [1.0, 0.0], False), (2, "k", [1.0, 0.0], True), (3, "k", [0.0, 1.0], False)],
        ASK + ", has_history boolean")
    got = {r.query_id: (r.branch, r.answer) for r in cache.route(table, asked).collect()}
    assert got == {1: ("hit", "A"), 2: ("bypass", None), 3: ("miss", None)}


def test_lookup_sees_every_row_of_a_large_cache(spark):
    rows = [("k", i, "q", [1.0, 0.0] if i == 0 else [-1.0, float(i)], f"A{i}") for i in range(900)]
    table = spark.createDataFrame(rows, CACHE)
    asked = spark.createDataFrame([(1, "k", [1.0, 0.0])], ASK)
    for rows_per_block in (20_000, 50):
        got = cache.lookup(table, asked, rows_per_block=rows_per_block).collect()
        assert [(r.hit, r.seq, r.answer) for r in got] == [(True, 0, "A0")]


def test_threshold_is_held_against_the_unrounded_similarity(spark):
    x = 0.8999996
    table = spark.createDataFrame([("k", 1, "q", [1.0, 0.0], "A")], CACHE)
    asked = spark.createDataFrame([(1, "k", [x, (1 - x * x) ** 0.5])], ASK)
    assert not cache.lookup(table, asked).first().hit


def test_fill_refuses_answers_with_history(spark):
    table = spark.createDataFrame([("k", 1, "q", [1.0, 0.0], "A")], CACHE)
    fresh = spark.createDataFrame(
        [("k", 2, "r", [0.0, 1.0], "B", False), ("k", 3, "s", [0.0, 1.0], "C", True),
         ("k", 4, "t", [0.0, 1.0], "", False)], CACHE + ", has_history boolean")
    assert {r.seq for r in cache.fill(table, fresh).collect()} == {1, 2}


def test_a_hot_kb_splits_into_parts_with_the_same_answers(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 4 else f"k{i % 3}", i, "q", rng.normal(size=3).tolist(), f"A{i}")
            for i in range(60)]
    asked = [(i, "hot" if i % 5 else f"k{i % 4}", rng.normal(size=3).tolist()) for i in range(300)]
    table, queries = spark.createDataFrame(rows, CACHE), spark.createDataFrame(asked, ASK)

    def found(**kw):
        return {r.query_id: (r.seq, r.similarity, r.answer) for r in cache.lookup(
            table, queries, 0.95, **kw).collect()}

    want = {}
    for qid, kb, q in asked:
        q = np.array(q)
        best = max(((round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6), s, a)
                    for b, s, _, v, a in rows if b == kb), default=(-2, None, None))
        want[qid] = (best[1], pytest.approx(best[0], abs=2e-6), best[2]) if best[0] >= 0.95 \
            else (None, None, None)
    assert found() == want
    assert found(rows_per_part=20) == want
    assert found(rows_per_part=20, rows_per_block=7) == want


@pytest.mark.parametrize("rows_per_part, rows_per_block, block_bytes", [(100_000, 20_000, 64 << 20), (7, 5, 2000)])
def test_lookup_in_a_clustered_cache_skips_far_blocks(spark, rows_per_part, rows_per_block, block_bytes):
    rng = np.random.default_rng(7)
    homes = rng.normal(size=(30, 12)) * 3
    rows = [(f"kb{i % 3}", i, (homes[rng.integers(30)] + rng.normal(size=12) * 0.3).tolist(), f"a{i}") for i in range(900)]
    rows += [("kb0", 900, [0.0] * 12, "zero"), ("kb0", 901, rows[0][2], "again"), ("void", 902, [1.0] * 12, "alone")]
    asked = [(i, f"kb{i % 4}", (homes[rng.integers(30)] + rng.normal(size=12) * 0.6).tolist()) for i in range(200)]
    asked += [(900, "kb0", rows[0][2]), (901, "kb0", [0.0] * 12), (902, None, [1.0] * 12)]
    held = spark.createDataFrame(rows, "kb_id string, seq long, embedding array<double>, answer string")
    questions = spark.createDataFrame(asked, "query_id long, kb_id string, embedding array<double>")

    def unit(v):
        return np.array(v) / max(1e-300, np.linalg.norm(v))

    for threshold in (0.9, 0.0):
        want = {}
        for q, kb, v in asked:
            scored = [(round(float(unit(v) @ unit(w)), 6), seq, a) for k, seq, w, a in rows
                      if k == kb and unit(v) @ unit(w) >= threshold]
            want[q] = max(scored) if scored else (None, None, None)
        got = cache.lookup(held, questions, threshold, rows_per_part, rows_per_block, block_bytes).collect()
        assert len(got) == len(asked)
        for r in got:
            assert (r.seq, r.answer) == want[r.query_id][1:] and r.hit == (r.seq is not None)
            assert r.similarity == pytest.approx(want[r.query_id][0], abs=2e-6)
    placed, cells = cache.cell_cache(held, 10)
    pairs = cache.asked_blocks(questions.filter("kb_id is not null"), cells, 0.9).count()
    every = sum(int(cells.blocks[kb].sum()) for _, kb, _ in asked if kb in cells.blocks)
    assert placed.count() == len(rows) and 0 < pairs < 0.35 * every


def test_a_question_goes_to_a_shelf_once_however_many_blocks_it_has(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, rng.normal(size=8).tolist(), f"a{i}") for i in range(2000)]
    held = spark.createDataFrame(rows, "kb_id string, seq long, embedding array<double>, answer string")
    asked = spark.createDataFrame([(i, "k", rng.normal(size=8).tolist()) for i in range(50)], ASK)
    for threshold in (0.0, 0.9):
        _, cells = cache.cell_cache(held, 10)
        assert cells.blocks["k"].sum() >= 200 and cache.asked_blocks(asked, cells, threshold).count() <= 50
        small = cache.cell_cache(held, 10, 2 * 10 * 64 * 50)[1]
        assert small.shelves("k").shape[1] > 1
        found = [{r.query_id: (r.seq, r.similarity) for r in cache.lookup(
            held, asked, threshold, rows_per_block=n, block_bytes=size).collect()} for n, size in (
            (10, 64 << 20), (10, 2 * 10 * 64 * 50), (20_000, 64 << 20))]
        assert found[0] == found[1] == found[2]
