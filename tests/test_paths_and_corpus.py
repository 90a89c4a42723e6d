import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus_search, path_policy as policy, traces

RULES = policy.PathRules(forbidden=("/t/danger",), allowed=("/t/allow",), base="/t/allow")


def judge(spark, paths, rules=RULES, write=False):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: (r.allowed, r.reason) for r in policy.classify(rows, rules, write).collect()}


def test_layers_answer_in_order(spark):
    got = judge(spark, [
        "/t/allow/report.csv", "/t/allow/sub/.env", "/t/allow/.env.local", "/t/allow/token.json",
        "/t/allow/tokens.json", "/t/allow/secretary.md", "/t/danger/run.sh", "/t/danger/a/b/c",
        "/t/danger/token", "/t/other/report.csv", "/t/allow/x/../../../t/other", "plan.txt",
        "/t/allowance/x"])
    ok = {p for p, (allowed, _) in got.items() if allowed}
    assert ok == {"/t/allow/report.csv", "/t/allow/tokens.json", "/t/allow/secretary.md", "plan.txt"}
    assert got["/t/danger/token"][1] == policy.REASON_FORBIDDEN + "/t/danger"
    assert got["/t/allow/.env.local"][1] == policy.REASON_SENSITIVE + ".env'"
    assert got["/t/other/report.csv"][1] == policy.REASON_OUTSIDE
    assert got["/t/allow/report.csv"][1] == ""


def test_writing_is_stricter(spark):
    got = judge(spark, ["/t/allow/conf/settings.json", "/t/allow/fresh.csv", "/t/other/fresh.csv",
                        "/t/allow/Dockerfile", "/t/allow/Dockerfile.md"], write=True)
    assert got["/t/allow/conf/settings.json"] == (False, policy.REASON_PROTECTED + "settings.json")
    assert got["/t/allow/fresh.csv"][0] and got["/t/allow/Dockerfile.md"][0]
    assert not got["/t/other/fresh.csv"][0] and not got["/t/allow/Dockerfile"][0]


def test_of_a_uri_the_path_is_judged(spark):
    got = judge(spark, [
        "file:/t/danger/x", "file:///t/danger/x", "hdfs://nn:8020/t/allow/../danger/x", "FILE:/t/allow/ok.md",
        "hdfs://nn/t/allow/ok.md", "s3x://bucket/t/allow/ok.md", "ftp:/t/allow/ok.md"])
    assert {p for p, (allowed, _) in got.items() if allowed} == {"FILE:/t/allow/ok.md", "hdfs://nn/t/allow/ok.md"}
    assert got["file:///t/danger/x"][1] == policy.REASON_FORBIDDEN + "/t/danger"
    assert got["s3x://bucket/t/allow/ok.md"][1] == policy.REASON_OUTSIDE


@pytest.mark.parametrize("path,inside", [
    ("D:\\Data\\raw\\x.csv", True), ("d:/data//", True), ("D:\\Data", True),
    ("D:\\Database\\x", False), ("D:\\Data.bak\\x", False)])
def test_prefixes_end_at_segments(spark, path, inside):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(policy.within(F.col("p"), "D:\\Data")).first()[0] is inside


def test_sensitive_sequences_and_order(spark):
    rows = spark.createDataFrame([("/h/.aws/config",), ("/h/.aws/credentials",), ("/h/.ssh/x",),
                                  ("/h/ID_RSA.pub",), ("/h/token/.env",), ("/h/a.env",)], "p string")
    got = [r[0] for r in rows.select(policy.sensitive_rule(F.col("p"))).collect()]
    assert got == [None, "credentials", ".ssh/", "id_rsa", ".env", None]


def test_normal_form(spark):
    rows = spark.createDataFrame([("/a/./b//../c/",), ("C:\\x\\..\\..\\y",), ("../q",), ("/..",)],
                                 "p string")
    got = [r[0] for r in rows.select(policy.normalize(F.col("p"), "/home")).collect()]
    assert got == ["/a/c", "C:/y", "/q", "/"]


def test_listing_counts_every_level(spark):
    files = spark.createDataFrame([("/a/b/x.md",), ("/a/b/y.md",), ("/a/z.md",)], "path string")
    entries = corpus_search.list_directories(files)
    got = {(r.directory, r.name): (r.kind, r.n_files) for r in entries.collect()}
    assert got == {("/", "a"): ("folder", 3), ("/a", "b"): ("folder", 2), ("/a", "z.md"): ("file", 1),
                   ("/a/b", "x.md"): ("file", 1), ("/a/b", "y.md"): ("file", 1)}
    asked = spark.createDataFrame([("/a",), ("/none",)], "directory string")
    counts = {r.directory: r.n_entries for r in corpus_search.directory_counts(entries, asked).collect()}
    assert counts == {"/a": 2, "/none": 0}


def test_preview_keeps_short_texts_whole(spark):
    long = "\n".join(str(i) for i in range(101))
    rows = spark.createDataFrame([(1, "\n".join(["x"] * 100)), (2, long)], "id long, text string")
    got = {r.id: r for r in corpus_search.preview(rows).collect()}
    assert (got[1].n_lines, got[1].tail) == (100, None)
    assert got[2].head.split("\n") == [str(i) for i in range(30)]
    assert got[2].tail.split("\n") == [str(i) for i in range(71, 101)]


def test_search_skips_suffixes_and_directories(spark):
    rows = spark.createDataFrame([
        ("/w/a.md", "Cat cat CATcat"), ("/w/b.bin", "cat"), ("/w/.git/c.md", "cat"),
        ("/w/my.github/d.md", "cat"), ("/w/venv.md", "cat")], "path string, text string")
    loose = {(r.path, r.hits) for r in corpus_search.search_keywords(rows, ["CAT", "dog"]).collect()}
    assert loose == {("/w/a.md", 4), ("/w/my.github/d.md", 1), ("/w/venv.md", 1)}
    strict = {r.path for r in corpus_search.search_keywords(rows, ["cat"], strict=True).collect()}
    assert strict == {"/w/a.md", "/w/venv.md"}


def test_ten_thousand_keywords_in_one_pass(spark):
    rng = random.Random(2)
    syllables = ["ka", "to", "mi", "é", "aa", "ra", "ß", "ſ"]
    words = sorted({"".join(rng.choices(syllables, k=rng.randrange(1, 6))) for _ in range(40_000)})[:10_000]
    words += ["AA", "", "Ka"]
    files = [(f"/w/f{i}.md", "".join(rng.choices([*syllables, " ", "AA"], k=400))) for i in range(40)]
    files += [("/w/none.md", None), ("/w/empty.md", ""), ("/w/.git/x.md", "ka"), ("/w/x.exe", "ka"), ("/w/a.md", "aaaaa")]
    table = spark.createDataFrame(files, "path string, text string")
    asked = spark.createDataFrame([(w, 1) for w in words] + [(None, 2), ("ka", 3)], "keyword string, word int")
    want = {}
    for path, text in files[:40] + files[-1:]:
        lowered = text.lower()
        for word in words:
            n = lowered.count(word.lower()) if word else 0
            if n:
                want[path, word] = n
    for block in (64 << 20, 200_000):
        got = corpus_search.search_keywords(table, asked, block_bytes=block).collect()
        assert {(r.path, r.keyword): r.hits for r in got} == want and len(got) == len(want)


def test_rules_as_rows_judge_as_rules_in_expressions(spark):
    rng = random.Random(3)
    names = ["home", "u", "etc", "a", ".ssh", ".env", ".env.local", "token.txt", "tokens", "credentials", ".aws",
             "Secret.d.e", "Dockerfile", "settings.json", "x.y", "Windows", "b c", "", ".", "..", "srv"]
    paths = [(i, rng.choice(["", "/", "/home/", "C:\\", "c:/Users/", "s3://b/", "file:///home/"])
              + rng.choice(["/", "\\"]).join(rng.choices(names, k=rng.randrange(1, 6)))) for i in range(600)]
    table = spark.createDataFrame([*paths, (-1, "/"), (-2, ""), (-3, "/home/u"), (-3, "/home/u")], "id long, path string")
    for rules in (policy.PathRules(), policy.PathRules(
            forbidden=("/home/a", "/srv/"), sensitive=("a/b c", ".aws/credentials/u", "x", ".env"), allowed=("/",),
            protected=("u",), base="/srv/x")):
        for for_write in (False, True):
            want = policy.classify(table, rules, for_write).collect()
            got = policy.classify_by_rules(table, policy.rule_rows(spark, rules), for_write, rules.base).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    many = policy.rule_rows(spark).unionByName(spark.range(10_000).select(
        F.lit("forbidden").alias("kind"), (F.col("id") + 100).alias("ord"), F.concat(F.lit("/home/n"), F.col("id")).alias("rule")))
    asked = spark.createDataFrame([(1, "/home/n77/x"), (2, "/home/n10000"), (3, "/home/N9999")], "id long, path string")
    judged = policy.classify_by_rules(asked, many).collect()
    assert {r.id: r.reason for r in judged} == {1: "系统目录禁止访问: /home/n77", 2: "", 3: "系统目录禁止访问: /home/n9999"}


def test_quantiles_are_exact_for_skewed_and_missing_groups(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, rng.random(), 1e9 * rng.random()])) for _ in range(30_000)]
    rows += [(None, float(i)) for i in range(7)] + [("one", -3.5), ("none", None)] + [("same", 2.0)] * 50
    got = traces.latency_summary(spark.createDataFrame(rows, "span string, ms double"), ["span"], (0.01, 0.5, 0.999)).collect()
    found = {}
    for r in got:
        found[r.span] = (r.n_spans, r.p1_ms, r.p50_ms, r.p100_ms)
    groups = {}
    for span, ms in rows:
        if ms is not None:
            groups.setdefault(span, []).append(ms)
    want = {}
    for span, values in groups.items():
        values.sort()
        want[span] = (len(values), *(values[max(1, math.ceil(len(values) * q)) - 1] for q in (0.01, 0.5, 0.999)))
    assert found == want


def test_listings_answer_as_a_tool(spark):
    files = spark.createDataFrame([("/home/a/x.md",), ("/home/a/sub/y.md",), ("/home/a/b.txt",)], "path string")
    asked = spark.createDataFrame([("/home/a",), ("/home/none",), ("/home/void",), ("/etc/x",), ("/home/.env",)], "directory string")
    known = spark.createDataFrame([("/home/void",), ("/home/a",)], "directory string")
    got = {r.directory: (r.state, r.text) for r in corpus_search.listing_texts(
        corpus_search.list_directories(files), asked, known=known).collect()}
    assert got["/home/a"] == ("listed", "目录 '/home/a' 包含 3 个文件/文件夹:\n  [文件] b.txt\n  [文件夹] sub\n  [文件] x.md")
    assert got["/home/none"] == ("missing", "目录 '/home/none' 不存在")
    assert got["/home/void"] == ("empty", "目录 '/home/void' 是空的")
    assert got["/etc/x"][1] == "安全拦截: " + policy.REASON_FORBIDDEN + "/etc" and got["/home/.env"][0] == "blocked"
    free = corpus_search.listing_texts(corpus_search.list_directories(files), asked, rules=None)
    assert {r.state for r in free.collect()} == {"listed", "missing"}
