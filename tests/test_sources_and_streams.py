import os
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer_cache, catalog, chunking, keyword
from corpusloom.operators.answer_cache import CacheStore
from corpusloom.operators.lexicon import Lexicon
from corpusloom.plans import cache_queries
from corpusloom.session import materialize, new_path, shared_dir
from corpusloom.sources import archive, files
from corpusloom.sources.store import ChunkStore
from corpusloom.streaming import ingest, questions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_files_are_read_whole_and_parsed_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"\xff bad \xe4\xb8\xad\n")
    (tmp_path / "empty.md").write_text(" \n ")
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "sub" / "p.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "sub" / "x.exe").write_bytes(b"MZ")
    (tmp_path / "README").write_text("no suffix")
    rows = files.parse(files.read_files(spark, str(tmp_path)))
    got = {r.source: r for r in rows.collect()}
    assert set(got) == {"a.TXT", "t.csv", "p.PNG", "x.exe", "README"}
    assert got["a.TXT"].text == "\ufffd bad 中" and got["a.TXT"].page is None
    assert got["t.csv"].text == "a,b\n1,2"
    assert got["p.PNG"].type == "image" and got["p.PNG"].image.endswith("/sub/p.PNG")
    assert (got["x.exe"].text, got["x.exe"].page) == ("[暂不支持的文件类型 .exe]", 1)
    listed = files.list_files(spark, str(tmp_path))
    assert listed.count() == 6 and "content" not in listed.columns


def test_extracted_pages_keep_their_numbers(spark):
    rows = spark.createDataFrame([("/a.pdf", " one ", 1), ("/a.pdf", "two", 2), ("/b.docx", None, None),
                                  ("/c.md", "x", 9)], "path string, text string, page int")
    got = [(r.source, r.text, r.page) for r in files.parse(rows).orderBy("source", "page").collect()]
    assert got == [("a.pdf", "one", 1), ("a.pdf", "two", 2), ("c.md", "x", None)]


def test_uploads_are_admitted_by_suffix_and_size(spark):
    rows = spark.createDataFrame([("/a.md", 20971520), ("/b.md", 20971521), ("/c.exe", 1),
                                  ("/d.PDF", 1)], "path string, length long")
    assert sorted(r.path for r in files.admitted(rows).collect()) == ["/a.md", "/d.PDF"]


def chunk_rows(spark, kb, n, text="some text"):
    return chunking.chunk_blocks(spark.range(n).select(
        F.lit(kb).alias("kb_id"), F.col("id").cast("string").alias("doc_id"),
        F.lit(text).alias("text"), F.lit(None).cast("int").alias("page"),
        F.lit("s").alias("source"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("image")))


def test_store_appends_replaces_and_drops(spark):
    store = ChunkStore(spark, new_path(spark, "store"))
    changed = store.append(chunk_rows(spark, "007", 3))
    store.append(chunk_rows(spark, "a/b c", 2))
    store.append(chunk_rows(spark, "007", 1))
    assert [r.kb_id for r in changed.collect()] == ["007"]
    counts = lambda: {r.kb_id: r["count"] for r in store.scan().groupBy("kb_id").count().collect()}
    assert counts() == {"007": 4, "a/b c": 2}
    row = store.scan(["007"]).first()
    assert (row.page, row.image, row.type) == (0, "", "text")
    plan = store.scan(["007"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*kb_id", plan)
    store.replace(chunk_rows(spark, "007", 1, "new"))
    assert counts() == {"007": 1, "a/b c": 2}
    store.drop(["a/b c", "missing"])
    assert counts() == {"007": 1}
    store.append(chunk_rows(spark, "z", 1))
    store.create(["007"])
    assert counts() == {"z": 1}


def test_catalog_rules(spark):
    kbs = spark.createDataFrame([("k1", "n", "", "2024-01-01"), ("k2", "n", "", "2024-01-02"),
                                 ("k0", "n", "", "2024-01-02")],
                                "kb_id string, name string, description string, created_at string")
    kbs = kbs.withColumn("created_at", F.to_timestamp("created_at"))
    assert [r.kb_id for r in catalog.list_kbs(kbs).collect()] == ["k0", "k2", "k1"]
    assert catalog.default_kb(kbs).first() == ("k0", False)
    assert catalog.default_kb(kbs.limit(0)).first() == (catalog.DEFAULT_KB, True)
    assert catalog.get_kb(kbs, "zz").count() == 0
    asked = kbs.limit(1).select(F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r2"))).alias("request_id"),
                                F.lit("new").alias("name"), "description", "created_at")
    fresh = [r.kb_id for r in catalog.create_kbs(kbs, asked).filter("name = 'new'").collect()]
    assert len(fresh) == len(set(fresh)) == 2

    uploads = spark.createDataFrame([("d1", "k1", "a.md", None), ("d2", "zz", "b.md", 5)],
                                    "doc_id string, kb_id string, filename string, file_size long")
    uploads = uploads.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    none = spark.createDataFrame([], "doc_id string, kb_id string, filename string, file_size long, "
                                     "chunk_count long, status string, created_at timestamp")
    registry = catalog.register_documents(none, kbs, uploads)
    assert [(r.doc_id, r.status, r.file_size) for r in registry.collect()] == [("d1", "processing", 0)]
    updates = spark.createDataFrame([("d1", 1, "ready", 7), ("d1", 2, "error", None)],
                                    "doc_id string, seq int, status string, chunk_count long")
    assert [(r.status, r.chunk_count) for r in catalog.update_status(registry, updates).collect()] == [("error", 0)]
    assert [r.doc_id for r in catalog.list_documents(registry, "k1").collect()] == ["d1"]
    left = catalog.delete_kbs({"kb": kbs, "doc": registry}, kbs.filter("kb_id = 'k1'"))
    assert left["kb"].count() == 2 and left["doc"].count() == 0


def test_bulk_import_runs_once(spark):
    incoming = spark.createDataFrame(
        [("k", "1", "a.md", "text", None), ("k", "2", "b.md", " ", None), ("k", "3", "c.md", None, "bad")],
        "kb_id string, doc_id string, filename string, text string, error string")
    incoming = incoming.withColumn("file_size", F.lit(1)).withColumn("created_at", F.current_timestamp())
    none = spark.createDataFrame([], "kb_id string, filename string, status string")
    rows, chunks = catalog.bulk_import(none, incoming)
    rows = rows.cache()
    assert {r.filename: (r.status, r.chunk_count) for r in rows.collect()} == {
        "seed_a.md": ("ready", 1), "seed_b.md": ("empty", 0), "seed_c.md": ("error", 0)}
    assert chunks.count() == 1
    again, more = catalog.bulk_import(rows, incoming)
    assert again.count() == 0 and more.count() == 0


def test_loose_texts_share_a_source_but_not_an_id(spark):
    texts = spark.createDataFrame([("k", "1", "same"), ("k", "2", "same"), ("k", "3", " ")],
                                  "kb_id string, text_id string, text string")
    got = catalog.add_texts(texts).collect()
    assert len(got) == 2 and len({r.chunk_id for r in got}) == 2
    assert {r.chunk_label for r in got} == {"agent__chunk0"}


def test_archive_skips_broken_files(spark, tmp_path):
    root = tmp_path / "summary"
    root.mkdir()
    (root / "eval_20240101_000000.json").write_text(
        '{\n "timestamp": "t1", "kb_id": "库", "test_size": 2,\n "results": [{"name": "a"}, {"name": "b"}]\n}')
    (root / "eval_20240102_000000.json").write_text('{"timestamp": "t2"}')
    (root / "eval_20240103_000000.json").write_text('{"timestamp": ')
    (root / "other.json").write_text('{"timestamp": "t4"}')
    got = archive.summarize_runs(archive.read_runs(spark, str(tmp_path), multi_line=True)).collect()
    assert [(r.run, r.timestamp, r.kb_id, r.test_size, r.configs) for r in got] == [
        ("eval_20240102_000000", "t2", "", 0, []),
        ("eval_20240101_000000", "t1", "库", 2, ["a", "b"])]


def test_streamed_ingest_equals_batch_and_runs_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (50 * i) + ".", "en", f"s{i % 3}", 0)
                                  for i in range(9)], DOCS)
    folder, target, state = str(tmp_path / "in"), new_path(spark, "out"), new_path(spark, "state")
    log_path, log_state = new_path(spark, "log"), new_path(spark, "state")

    def run():
        stream = ingest.document_stream(spark, folder, "*.parquet", files_per_batch=1)
        ingest.start_ingest(stream, target, state).awaitTermination()
        ingest.start_registry(stream, log_path, log_state).awaitTermination()

    docs.filter("doc_id < 6").repartition(2).write.parquet(folder)
    run()
    run()
    docs.filter("doc_id >= 6").write.mode("append").parquet(folder)
    run()
    want = chunking.chunk_blocks(files.corpus_blocks(docs))
    got = ingest.read_chunks(spark, target)
    cols = ["kb_id", "chunk_id", "content"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    log = ingest.read_log(spark, log_path)
    assert log.count() == 9 and log.select("batch_id").distinct().count() >= 3
    counts = {r.doc_id: r.chunk_count for r in ingest.current_documents(log).collect()}
    assert sum(counts.values()) == want.count()
    last = log.agg(F.max("batch_id")).first()[0]
    assert ingest.changed_kbs(log, last).count() == 0 < ingest.changed_kbs(log).count()


@pytest.mark.parametrize("name", ["stream_ingest", "stream_registry"])
def test_streams_read_a_table_kept_as_a_folder(spark, tmp_path, name):
    rows = [(i, f"Text number {i}. " * (20 * i), "en", f"src{i % 2}", 0) for i in range(1, 5)]
    spark.createDataFrame(rows, ingest.DOCUMENT_SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (2,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = cache_queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "stream_ingest":
        assert {r.doc_id for r in got} == {1, 2, 3, 4}
    else:
        counts = {r.kb_id: (r.n_rows, r.n_chunks) for r in got if r.part == "documents"}
        assert set(counts) == {"src0", "src1"} and all(n == 2 < c for n, c in counts.values())
        assert [r.kb_id for r in got if r.part == "cache"] == ["src2"]


def test_streamed_lookup_equals_batch(spark):
    cache = spark.createDataFrame([("k", 1, [1.0, 0.0], "A"), ("k", 2, [0.0, 1.0], "B")],
                                  "kb_id string, seq long, embedding array<double>, answer string")
    asked = spark.createDataFrame([(1, "k", [1.0, 0.1]), (2, "k", [0.7, 0.7]), (3, "z", [1.0, 0.0])],
                                  "query_id long, kb_id string, embedding array<double>")
    path, target = new_path(spark, "asked"), new_path(spark, "found")
    asked.write.parquet(path)
    questions.start_lookup(spark.readStream.schema(asked.schema).parquet(path), cache, target,
                           new_path(spark, "state")).awaitTermination()
    cols = ["query_id", "hit", "similarity", "answer"]
    assert sorted(map(str, spark.read.parquet(target).select(cols).collect())) == sorted(
        map(str, answer_cache.lookup(cache, asked).select(cols).collect()))


def fake_session(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_dir_follows_the_session(spark):
    cluster = fake_session("yarn", "hdfs://shared/work/")
    assert shared_dir(cluster) == "hdfs://shared/work"
    assert new_path(cluster, "x").startswith("hdfs://shared/work/corpusloom/app-1/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake_session("yarn", None))
    assert os.path.isdir(shared_dir(spark))


def test_one_document_in_two_kbs_keeps_apart(spark):
    blocks = spark.createDataFrame(
        [("a", 1, "same text", None, "s", "text", None), ("b", 1, "same text", None, "s", "text", None)],
        "kb_id string, doc_id long, text string, page int, source string, type string, image string")
    ids = [r.chunk_id for r in chunking.chunk_blocks(blocks).collect()]
    assert len(set(ids)) == 2


def test_every_path_is_loaded_or_refused(spark):
    rows = [("k", i, path, text) for i, (path, text) in enumerate([
        ("/home/u/a.md", "text"), ("/home/u/b.pdf", None), ("/home/u/c.docx", " "), ("/home/u/d.png", None),
        ("/home/u/e.xyz", None), ("file:/etc/passwd", "x"), ("file:///home/u/f.txt", "fine"), ("/home/u/g.txt", None)])]
    df = spark.createDataFrame(rows, "kb_id string, doc_id long, path string, text string")
    chunks, rejected = files.guarded_load(df)
    loaded = {r.doc_id for r in chunks.collect()}
    refused = {r.path for r in rejected.collect()}
    assert loaded == {0, 3, 4, 6}
    assert refused == {"/home/u/b.pdf", "/home/u/c.docx", "file:/etc/passwd", "/home/u/g.txt"}


def test_an_unwritten_store_is_empty(spark, tmp_path):
    shelf = ChunkStore(spark, str(tmp_path / "none"))
    assert shelf.scan().count() == 0
    assert {r.kb_id for r in shelf.drop(["x"]).collect()} == {"x"}


def test_a_run_saved_twice_counts_once(spark, tmp_path):
    runs = spark.createDataFrame([("eval_20240101_000000", "t", "k", 1, [])],
                                 "run string, timestamp string, kb_id string, test_size long, results array<string>")
    details = spark.createDataFrame([("eval_20240101_000000", "c", 1, 0.5, 0.5, 0.5, 0.5)],
                                    "run string, config string, query_id long, context_precision double, "
                                    "context_recall double, faithfulness double, answer_relevancy double")
    for _ in range(2):
        archive.save_runs(runs, details, str(tmp_path / "runs"))
    assert archive.read_details(spark, str(tmp_path / "runs")).count() == 1


def test_statistics_follow_the_store(spark, tmp_path):
    lexicon = Lexicon(spark, str(tmp_path / "lexicon"))
    store = ChunkStore(spark, str(tmp_path / "store"), lexicon)

    def chunks(kb, *texts):
        rows = [(kb, "d", f"{kb}{i}", "s_chunk0", 0, t, None, "s", "text", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "kb_id string, doc_id string, chunk_id string, chunk_label string, chunk_index int, "
                                           "content string, page int, source string, type string, image string")

    def same():
        held = store.scan()
        corpus = keyword.corpus_statistics(held)
        want = keyword.term_statistics(held, materialize(corpus, "corpus"))
        terms, totals = lexicon.statistics()
        assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, corpus.collect()))

    assert lexicon.version() == 0 and lexicon.statistics()[0].count() == 0
    store.append(chunks("a", "red cat", "red red dog", "..."))
    store.append(chunks("b", "blue cat").union(chunks("a", "sun")))
    same()
    before = sorted(map(tuple, lexicon.statistics()[0].collect()))
    store.replace(chunks("a", "moon moon", "cat"))
    same()
    store.drop(["b", "void"])
    same()
    assert lexicon.version() == 4
    assert sorted(map(tuple, lexicon.statistics(2)[0].collect())) == before
    lexicon.compact()
    same()
    store.append(chunks("c", "new words"))
    same()
    store.drop(["a", "c"])
    assert lexicon.totals().count() == 0


def test_cache_versions(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "cache"), "kb_id string, seq long, answer string", keep=2)
    assert store.current().count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "kb_id string, seq long, answer string")
    assert store.publish(rows) == 1
    reader = store.current()
    store.insert(spark.createDataFrame([("a", 3, "z"), ("a", 4, "")], rows.schema))
    assert reader.count() == 2 and {r.seq for r in store.current().collect()} == {1, 2, 3}
    store.invalidate(spark.createDataFrame([("a",)], "kb_id string"))
    assert [tuple(r) for r in store.current().collect()] == [("b", 2, "y")] and store.versions() == [2, 3]


def test_a_file_written_twice_leaves_its_second_text(spark, tmp_path):
    folder, target = tmp_path / "in" / "kb", str(tmp_path / "out")
    folder.mkdir(parents=True)
    cache = CacheStore(spark, str(tmp_path / "cache"), "kb_id string, seq long")
    answers = spark.createDataFrame([("kb", 1), ("other", 2)], "kb_id string, seq long")
    (folder / "a.md").write_text("first text of a")
    (folder / "b.md").write_text("text of b")

    def held():
        return sorted(r.content for r in ingest.latest_chunks(spark, target).collect())

    cache.publish(answers)
    assert ingest.ingest_changed_files(spark, str(tmp_path / "in"), target, cache) == 2
    assert held() == ["first text of a", "text of b"]
    assert [r.kb_id for r in cache.current().collect()] == ["other"]
    assert ingest.ingest_changed_files(spark, str(tmp_path / "in"), target) == 0
    (folder / "a.md").write_text("second text of a, and longer")
    os.utime(folder / "a.md", (4_000_000_000, 4_000_000_000))
    (folder / "c.md").write_text("text of c")
    assert ingest.ingest_changed_files(spark, str(tmp_path / "in"), target) == 2
    assert held() == ["second text of a, and longer", "text of b", "text of c"]
    (folder / "a.md").write_text(" ")
    os.utime(folder / "a.md", (4_000_000_100, 4_000_000_100))
    assert ingest.ingest_changed_files(spark, str(tmp_path / "in"), target) == 1
    assert held() == ["text of b", "text of c"]


def test_the_default_kb_is_created_where_there_is_none(spark):
    kbs = spark.createDataFrame([("k", "n", "d")], "kb_id string, name string, description string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.kb_id for r in catalog.with_default_kb(kbs, now).collect()] == ["k"]
    made = catalog.with_default_kb(kbs.limit(0), now)
    assert [(r.kb_id, r.name) for r in made.collect()] == [("agent", "agent")] and made.columns == kbs.columns
    assert not catalog.default_kb(made).first().is_new


def test_texts_become_a_file_each_made_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"text {i}\nof two lines") for i in range(60)],
                                 "source string, text string").coalesce(1)
    folder = tmp_path / "texts"
    files.write_texts(rows, str(folder))
    made = sorted(folder.rglob("*.txt"))
    assert sorted(f.read_text().strip() for f in made) == sorted(f"text {i}\nof two lines" for i in range(60))
    assert {f.parent.name for f in made} == {"source=a", "source=b"}
    assert not list(folder.rglob("*.crc"))
    assert len({f.name.split("-")[1] for f in made}) > 1


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(150):
        (tmp_path / "in" / f"{i}.txt").write_text(f"text {i}")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with ingest.small_files(spark):
        query = ingest.start_ingest(ingest.text_file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"),
                                    str(tmp_path / "state"))
        query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 64
    assert spark.conf.get(name) == before
    assert ingest.read_chunks(spark, str(tmp_path / "out")).count() == 150


def test_files_are_dealt_out_to_folders_of_even_size_and_named_as_spark_names_them(spark, tmp_path):
    sources = ["a", "b/c", "d=e f", "50%", "é{1}", "x\ty", ""]
    rows = [(sources[i % 7], f"text {i}\nof two lines" if i else "") for i in range(100)]
    texts = spark.createDataFrame(rows, "source string, text string")
    files.write_texts(texts, str(tmp_path / "ours"), parts=4)
    texts.write.partitionBy("source").text(str(tmp_path / "spark"))
    made = [f for f in (tmp_path / "ours").rglob("*") if f.is_file()]
    by_part = Counter(f.parent.parent.name for f in made)
    assert set(by_part) == {f"part={i}" for i in range(4)} and max(by_part.values()) <= 30 and len(made) == 100
    named = {d.name for d in (tmp_path / "spark").iterdir() if d.is_dir()}
    assert {f.parent.name for f in made} == named and "source=b%2Fc" in named
    assert sorted(f.read_text() for f in made) == sorted(text + "\n" for _, text in rows)


def test_folders_are_streams_of_their_own_whose_files_the_driver_forgets(spark, tmp_path):
    for part in range(6):
        for i in range(40):
            file = tmp_path / "in" / f"part={part}" / "source=k" / f"{i}.txt"
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(f"text {part} {i}")
    (tmp_path / "in" / "_done").mkdir()
    seen = []
    known = ingest.text_file_stream
    folder, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def told(spark, folder, *more):
        seen.append((folder, spark.conf.get("spark.sql.hive.manageFilesourcePartitions")))
        return known(spark, folder, *more)

    before = spark.conf.get("spark.sql.hive.manageFilesourcePartitions")
    try:
        ingest.text_file_stream = told
        ingest.ingest_folders(spark, folder, target, state)
    finally:
        ingest.text_file_stream = known
    # No stream knows of more than one folder, and what it lists is not kept by the session.
    assert seen == [(f"{folder}/part={i}", "false") for i in range(6)]
    assert spark.conf.get("spark.sql.hive.manageFilesourcePartitions") == before
    assert ingest.read_chunks(spark, target).count() == 240
    # What comes later is taken in once more and alone.
    (tmp_path / "in" / "part=2" / "source=k" / "new.txt").write_text("text new")
    ingest.ingest_folders(spark, folder, target, state)
    assert ingest.read_chunks(spark, target).count() == 241
    assert ingest.read_chunks(spark, target).select("content").distinct().count() == 241
