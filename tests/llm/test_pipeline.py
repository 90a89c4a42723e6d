"""The pipeline on a small corpus, stage by stage against plain Python."""

import random
import re

import corpus_pipeline
from corpusloom.llm.quality import classify_quality
from tests.llm.test_dedup import brute as near_brute
from tests.llm.test_mixing import brute as mix_brute, size_of


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(900)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.choice([30, 80, 200]))) + "."
        rows.append((i, text))
        if i % 6 == 0:
            rows.append((200 + i, text.replace(" ", "  \n", 3)))
        if i % 5 == 0:
            parts = text.split(" ")
            parts[len(parts) // 2] = "changed"
            rows.append((300 + i, " ".join(parts)))
    rows += [(500 + i, "### $$$ *** " * rng.randrange(4, 30)) for i in range(40)]
    docs = [(i, t, "en", "s" + str(i % 3), len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    steps = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{n}")
        table = spark.read.parquet(f"{tmp_path}/stage{n}")
        steps.append(table.collect())
        if n < 4:
            assert table.columns == columns

    raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in classify_quality(raw, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
            if r.kept}
    assert good == {i for i, _ in rows if i < 500} == {r.doc_id for r in steps[0]}
    seen, exact = set(), []
    for r in sorted(steps[0]):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if norm not in seen:
            exact.append((r.doc_id, r.text))
        seen.add(norm)
    assert sorted((r.doc_id, r.text) for r in steps[1]) == exact
    near = [d for d, _, _, kept in near_brute(exact, 5) if kept]
    assert sorted(r.doc_id for r in steps[2]) == sorted(near) and len(near) < len(exact)
    plan = mix_brute([(r.doc_id, r.text, r.source) for r in steps[2]])
    taken = {d: t for d, _, _, _, t in plan if t}
    got = {}
    for r in steps[3]:
        got[r.doc_id] = got.get(r.doc_id, 0) + size_of(r.text)
    assert got == taken
    pieces = {}
    for r in steps[4]:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert set(pieces) == set(taken)
    assert sorted({r.sequence_id for r in steps[4]}) == list(range(-(-sum(pieces.values()) // 2048)))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in steps[4])


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(900)]

    def text(n=60):
        return " ".join(rng.choices(words, k=n)) + "."

    good = [(i, text()) for i in range(60)]
    junk = [(500 + i, "### $$$ *** " * rng.randrange(4, 30)) for i in range(40)]
    copied, null_copy, near = text(), text(), text(80)
    parts = near.split(" ")
    parts[40] = "changed"
    clean = [text() for _ in range(9)]
    odd = [(700, copied), (700, copied), (700, copied), (701, good[0][1]), (701, clean[0]),
           (702, "### $$$ *** " * 12), (702, clean[1]), (None, clean[2]), (None, clean[3]),
           (None, null_copy), (None, null_copy), (None, good[1][1]), (None, "### $$$ *** " * 11),
           (703, near), (None, " ".join(parts)), (703, clean[4])]
    want = sorted([t for _, t in good] + [copied, null_copy, near, *clean[:5]])
    rows = [(i, t, "en", "s0", len(t)) for i, t in good + junk + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        table = spark.read.parquet(f"{tmp_path}/stage{n}")
        if n == 2:
            assert sorted(r.text for r in table.collect()) == want
            assert [r.doc_id for r in table.collect() if r.text == near] == [703]
    # One source, so the mix takes one and a half times the words of all, null ids too.
    mixed = [r.text for r in table.collect()]
    assert sum(map(size_of, mixed)) == sum(map(size_of, want)) * 3 // 2
    assert set(want) <= set(mixed)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0")
    assert pieces.count() == len(mixed)
    assert pieces.filter("doc_id is null").count() == sum(r.doc_id is None for r in table.collect())


def test_clashing_names_and_no_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(50)), "en", "s0", 300, i, -i, "k", "m", 1, 2)
            for i in range(60)]
    rows += [(500 + i, "### $$$ *** " * 9, "en", "s0", 100, i, -i, "k", "m", 1, 2) for i in range(40)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, "
                                       "_mix_id long, _key string, _metadata string, id int, label int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(30)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == docs.columns
    assert sorted(map(tuple, table.collect())) == sorted(rows[:60])
    mixed = corpus_pipeline.mixing(spark, table, str(tmp_path))
    assert mixed.columns == docs.columns and {(r.doc_id, r["_row"], r["_mix_id"]) for r in mixed.collect()} == {
        (i, i, -i) for i in range(60)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
