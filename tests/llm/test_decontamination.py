"""Benchmark decontamination against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import pytest

from corpusloom.llm import positional_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text):
    found = words(text)
    size = min(10, len(found))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute(docs, items):
    known = {}
    for item, text in items:
        for w in windows(text):
            known.setdefault(w, set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        found, hit, names = words(text), set(), set()
        for size in {len(w) for w in known}:
            for i in range(len(found) - size + 1):
                of = known.get(tuple(found[i:i + size]))
                if of:
                    names |= of
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def near(docs, items, reach):
    """Items with a window whose words are all around one occurrence of its rarest word."""
    count = {}
    for _, text in docs:
        for w in words(text):
            count[w] = count.get(w, 0) + 1
    out = []
    for _, text in docs:
        found, names = words(text), set()
        for item, item_text in items:
            for window in windows(item_text):
                rarest = min(window, key=lambda w: count.get(w, 0))
                if any(w == rarest and set(window) <= set(found[max(0, i - reach):i + reach + 1])
                       for i, w in enumerate(found)):
                    names.add("" if item is None else str(item))
        out.append(len(names))
    return out


def table(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["Ünï", "九", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for i in range(12)]
    items += [(3, "The, w1 -- THE"), (None, "w2 w3 w2"), (50, None), (51, "..."), (52, items[0][1])]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            passage = words(rng.choice(items)[1])
            lo = rng.randrange(0, len(passage) + 1)
            text[len(text) // 2:len(text) // 2] = passage[lo:lo + rng.randrange(1, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).title()))
    docs += [(None, items[0][1]), (None, None), (7, items[1][1]), (7, items[1][1]), (80, ""),
             (81, " ".join(["the"] * 5000 + words(items[2][1])))]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(pi, "BLOCK_WORDS", block)
    docs, items = table(block)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs],
                               "doc_id long, text string, items string, row int").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = pi.contamination(df, tests).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(docs, items)
    assert sorted(r.n_near for r in got) == sorted(near(docs, items, pi.REACH))


def test_small_shards_give_the_same(spark, monkeypatch):
    docs, items = table(5)
    monkeypatch.setattr(pi, "SHARD_BYTES", 300)
    monkeypatch.setattr(pi, "STEP_POSTINGS", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = pi.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert pi.contamination(docs.limit(0), items).count() == 0
    assert [tuple(r)[1:4] for r in pi.contamination(docs, items.limit(0)).orderBy("doc_id").collect()] == [
        (2, 0, 0), (0, 0, 0)]


def test_a_search_reads_the_buckets_of_its_terms(spark):
    docs = spark.createDataFrame([(i, f"only{i} some words here") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "only7 some")], "item_id long, text string")
    found = pi.phrase_matches(pi.build_index(docs), items)
    assert [tuple(r.spans[0]) for r in found.collect()] == [(0, 2)]
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x)
    assert 0 < scan.count("binary") <= 6
