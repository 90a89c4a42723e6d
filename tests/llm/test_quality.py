"""The quality classifier: held-out accuracy on the given labels, and odd inputs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality
from corpusloom.llm.quality import Logistic, View, classify_quality, co_train, keep_good, pseudo_slopes

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    rows = classify_quality(docs, fitted).join(held, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    good = [r.kept for r in rows if r.quality == 1]
    assert right / len(rows) > 0.95 and sum(good) / len(good) > 0.98


def test_every_row_is_scored(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta."], k=30)), "s", "en", 100) for i in range(60)]
    rows += [(100 + i, "### *** $$$ " * 10, "s", "en", 100) for i in range(60)]
    rows += [(900, None, None, None, None), (901, "", "t", "xx", -5), (902, "word " * 60_000, "s", "en", 1),
             (None, "no id", "s", "en", 3), (7, "again the same id", "s", "en", 5)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows],
                               "doc_id long, text string, source string, lang string, n_chars int, score double")
    labels = spark.createDataFrame(
        [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(3, None), (None, 1), (55, 7)],
        "doc_id long, quality int")
    got = classify_quality(df, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(60) if i != 7) and not any(kept[100 + i] for i in range(60))
    again = classify_quality(df.repartition(5), labels).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert classify_quality(df.limit(0), labels).count() == 0
    for useless in (labels.limit(0), labels.filter("quality = 1")):
        rest = classify_quality(df, useless).collect()
        assert len(rest) == len(rows) and all(r.kept and r.score is None for r in rest)
    assert len(classify_quality(df.select("doc_id", "text"), labels).collect()) == len(rows)


def test_pseudo_labels_help_the_other_view():
    rng = np.random.default_rng(1)

    def view(y, strength):
        return rng.normal(0, 1, (len(y), 4)) + strength * (2 * y[:, None] - 1)

    y, pool_y, test_y = (rng.integers(0, 2, n).astype(float) for n in (24, 3000, 2000))
    sets = [[view(part, s) for s in (2.0, 0.5)] for part in (y, pool_y, test_y)]
    model = co_train(sets[0], y, lambda history, now: pseudo_slopes(history, now, sets[1]))
    alone = Logistic.fit(sets[0][1], y)

    def hits(odds):
        return ((odds > 0) == (test_y == 1)).mean()

    assert hits(model.views[1].log_odds(sets[2][1])) > hits(alone.log_odds(sets[2][1])) - 0.01
    assert ((model.scores(sets[2])[2] > 0.5) == (test_y == 1)).mean() > 0.95
    assert quality.ROUNDS >= 1


def test_the_pool_is_the_whole_table_and_an_id_counts_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta."], k=30)), "s", "en", 100) for i in range(60)]
    rows += [(100 + i, "### *** $$$ " * 10, "t", "en", 100) for i in range(60)]
    rows += [(1, f"alpha beta gamma {i}", "s", "en", 100) for i in range(500)] + [(None, "gamma delta", "s", "en", 9)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    seen = []
    told_by = quality.co_train

    def spy(labelled, y, pool):
        views = [View(Logistic.fit(x, y), Logistic.fit(x[:, :1], y), True) for x in labelled]
        seen.append((len(y), [n for n, _, _ in pool([views], [v.model for v in views])]))
        return told_by(labelled, y, pool)

    monkeypatch.setattr(quality, "co_train", spy)
    got = classify_quality(df, labels).collect()
    assert seen[0][0] == 80 and 0 < max(seen[0][1]) <= 70 and len(got) == len(rows)
    good = keep_good(df.withColumn("text_view", F.lit(1)).withColumn("label", F.lit("x")), labels)
    assert good.columns == [*df.columns, "text_view", "label"]
    assert sorted((r.doc_id or -1, r.text) for r in good.collect()) == sorted(
        (i or -1, t) for i, t, *_ in rows if "#" not in t)
