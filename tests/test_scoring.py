import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scoring, traces

BODY = json.dumps({"context_recall": 4, "context_precision": 5, "faithfulness": 3,
                   "answer_relevancy": 2, "comment": "ok"})


def parse(spark, *raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "question_id long, raw string")
    return scoring.parse_judgements(rows).orderBy("question_id").collect()


def test_judgements_are_read_bare_or_fenced(spark):
    got = parse(spark, BODY, f"Sure:\n```json\n{BODY}\n```\nbye", f"```\n{BODY}\n```",
                f" \n{BODY}\n")
    assert [(r.context_recall, r.answer_relevancy, r.comment, r.error) for r in got] == [
        (4.0, 2.0, "ok", None)] * 4


def test_unreadable_judgements_carry_an_error(spark):
    got = parse(spark, "x" * 500, BODY + " tail", "```json\nnope\n```", None)
    assert all(r.error == scoring.PARSE_ERROR and r.faithfulness is None for r in got)
    assert got[0].raw_head == "x" * 200 and got[2].raw_head == "\nnope\n"


def test_a_missing_score_is_left_out_of_its_mean_only(spark):
    partial = json.dumps({"context_recall": 1, "comment": "?"})
    parsed = scoring.parse_judgements(spark.createDataFrame(
        [(1, BODY), (2, partial), (3, "junk")], "question_id long, raw string"))
    row = scoring.mean_judgements(parsed).first()
    assert (row.context_recall, row.faithfulness, row.n_judged, row.error) == (2.5, 3.0, 2, None)
    empty = scoring.mean_judgements(parsed.limit(0)).first()
    assert empty.error == scoring.EMPTY_TEST_SET and empty.context_recall == 0.0


def test_percent_tolerates_anything(spark):
    rows = spark.createDataFrame([("0.4567",), (None,), ("nan",), ("abc",), ("1",)], "v string")
    assert [r[0] for r in rows.select(scoring.to_percent(F.col("v"))).collect()] == [
        45.7, 0.0, 0.0, 0.0, 100.0]


def test_context_precision_rewards_early_hits(spark):
    rows = [(1, i + 1, v) for i, v in enumerate([1, 0, 1])] + [(2, 1, 0), (2, 2, 0)]
    got = {r.q: r.context_precision for r in scoring.context_precision(
        spark.createDataFrame(rows, "q long, rank int, verdict int"), ["q"]).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2), 2: None}


def test_means_treat_missing_scores_as_zero_unless_strict(spark):
    rows = spark.createDataFrame(
        [("c", 1.0, 0.5, float("nan"), 0.25), ("c", 0.0, 0.5, 1.0, None)],
        "config string, context_precision double, context_recall double, faithfulness double, answer_relevancy double")
    mean = scoring.mean_metrics(rows, ["config"]).first()
    assert (mean.context_precision, mean.faithfulness, mean.answer_relevancy) == (50.0, 50.0, 12.5)
    strict = scoring.mean_metrics(rows, ["config"], strict=True).first()
    assert (strict.context_precision, strict.faithfulness, strict.answer_relevancy) == (50.0, 0.0, 0.0)


def test_means_halfway_between_percents_do_not_depend_on_the_order_of_rows(spark):
    # Their mean is 0.6725; added up in some orders it comes out an ulp off.
    scores = [0.16666666666666666, 1.0, 0.95, 0.45, 1.0, 0.6666666666666666, 0.8875, 0.75, 0.25, 0.6041666666666666]
    found = set()
    for turn in range(len(scores)):
        rows = [("c", i, x, x, x, x) for i, x in enumerate(scores[turn:] + scores[:turn])]
        per = spark.createDataFrame(
            rows, "config string, query_id long, " + ", ".join(f"{m} double" for m in scoring.METRICS)).coalesce(1)
        found.add(scoring.mean_metrics(per, ["config"]).first().faithfulness)
    assert found == {67.2}


def test_configs_cut_one_retrieval(spark):
    hits = spark.createDataFrame([(1, r) for r in range(1, 7)], "query_id long, rank int")
    got = scoring.cut_per_config(hits, [("three", 3), ("five", 5)]).groupBy("config").count()
    assert {r.config: r["count"] for r in got.collect()} == {"three": 3, "five": 5}
    with pytest.raises(ValueError, match=scoring.NO_CONFIGS):
        scoring.cut_per_config(hits, [])


def test_judge_prompt_shows_five_contexts(spark):
    items = spark.createDataFrame([(1, "Q", "R", [f"c{i}" for i in range(7)], "A")],
                                  "question_id long, question string, reference string, contexts array<string>, answer string")
    prompt = scoring.judge_prompts(items).first().prompt
    assert "c0\n\n---\n\nc1" in prompt and "c4" in prompt and "c5" not in prompt


def test_word_overlap(spark):
    rows = spark.createDataFrame([("red Red cat", "a RED dog"), ("...", "x")], "a string, b string")
    got = [r.overlap for r in scoring.word_overlap(rows, "a", "b").collect()]
    assert got == [0.5, 0.0]
    assert scoring.demo_questions(spark).count() == 5


def test_run_summary_caps_steps_and_skips_tool_messages(spark):
    rows = [(1, 0, "call_model", True, "calling"), (1, 1, "call_tools", False, "result"),
            (1, 2, "call_model", False, "done"), (2, 0, "call_model", True, "x"),
            (3, 0, "call_tools", False, "y"), (5, 0, "call_model", False, "")]
    rows += [(4, i, "call_model", False, str(i)) for i in range(12)]
    got = {r.session: (r.steps, r.answer) for r in traces.summarize_runs(spark.createDataFrame(
        rows, "session long, step long, node string, has_tool_calls boolean, content string")).collect()}
    assert got == {1: (2, "done"), 2: (1, traces.NO_ANSWER), 3: (0, traces.NO_ANSWER),
                   4: (8, "7"), 5: (1, traces.NO_ANSWER)}


def test_latency_quantiles_are_exact(spark):
    spans = spark.range(4001).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("span"),
        ((F.col("id") * 7919 % 4001) / 8.0 - 20).alias("ms"))
    got = {r.span: r for r in traces.latency_summary(spans, ["span"], (0.25, 0.5, 0.95)).collect()}
    data = {}
    for r in spans.collect():
        data.setdefault(r.span, []).append(r.ms)
    for span, values in data.items():
        values.sort()
        for q, name in ((0.25, "p25_ms"), (0.5, "p50_ms"), (0.95, "p95_ms")):
            assert got[span][name] == values[math.ceil(q * len(values)) - 1]
        assert got[span].n_spans == len(values)
        assert got[span].mean_ms == pytest.approx(sum(values) / len(values))
