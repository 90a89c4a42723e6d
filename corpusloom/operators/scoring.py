"""Judge responses and retrieval metrics: parse, aggregate, compare configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.functions.text import tokenize
from corpusloom.functions.vectors import cosine
from corpusloom.operators.context import BLOCK_SEPARATOR

# Metric names, judged contexts, kept characters of an unreadable response.
METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
JUDGED_CONTEXTS = 5
RAW_CHARS = 200
_MEAN_DIGITS = 12
PARSE_ERROR = "JSON 解析失败"
EMPTY_TEST_SET = "测试集为空"
NO_CONFIGS = "配置为空"

_SCORES = "context_recall double, context_precision double, faithfulness double, " \
          "answer_relevancy double, comment string"

JUDGE_PROMPT = (
    "Rate a retrieval-augmented answer.\n\n## Question\n", "\n\n## Reference answer\n",
    "\n\n## Retrieved passages\n", "\n\n## Generated answer\n",
    "\n\n## Task\nGive 1 to 5 points each for context_recall (key facts of the reference are "
    "among the passages), context_precision (relevant passages come first), faithfulness "
    "(nothing is made up) and answer_relevancy (the question is answered). Reply with one "
    "JSON object holding these four numbers and a one-sentence comment.",
)


def judge_prompts(items: DataFrame, parts: tuple[str, ...] = JUDGE_PROMPT) -> DataFrame:
    """(question_id, prompt) from question, reference, contexts (array) and answer.

    Only the first five contexts are shown to the judge.
    """
    shown = F.array_join(F.slice("contexts", 1, JUDGED_CONTEXTS), BLOCK_SEPARATOR)
    return items.select("question_id", F.concat(
        F.lit(parts[0]), F.col("question"), F.lit(parts[1]), F.col("reference"),
        F.lit(parts[2]), shown, F.lit(parts[3]), F.col("answer"), F.lit(parts[4]),
    ).alias("prompt"))


def parse_judgements(responses: DataFrame) -> DataFrame:
    """Add the four scores, comment and error to rows of (question_id, raw).

    The whole text is read as JSON, else the inside of a ```` ```json ```` fence, else that
    of a plain fence. Unreadable responses carry an error and their first 200 characters.
    A missing score stays null.
    """
    raw = F.col("raw")
    after = F.when(F.instr(raw, "```json") > 0, F.element_at(F.split(raw, "```json"), 2)) \
        .when(F.instr(raw, "```") > 0, F.element_at(F.split(raw, "```"), 2))
    fenced = F.element_at(F.split(after, "```"), 1)

    def read(text: Column) -> Column:
        # Read as a list of one: whatever follows the object makes the list unreadable or longer.
        whole = F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.concat(F.lit("["), text, F.lit("]")))
        parsed = F.from_json(whole, f"array<struct<{_SCORES}>>")
        return F.when(F.size(parsed) == 1, F.element_at(parsed, 1))

    found = responses.withColumn("_s", F.coalesce(read(raw), read(fenced)))
    bad = F.col("_s").isNull()
    return found.select(
        *responses.columns, *[F.col(f"_s.{m}").alias(m) for m in METRICS],
        F.col("_s.comment").alias("comment"),
        F.when(bad, F.lit(PARSE_ERROR)).alias("error"),
        F.when(bad, F.substring(F.coalesce(fenced, raw), 1, RAW_CHARS)).alias("raw_head"))


def mean_judgements(parsed: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean of each score over readable responses, two decimals, 0 when there are none.

    ``n_judged`` counts the readable ones; an empty test set reports an error.
    """
    ok = F.col("error").isNull()
    means = [F.coalesce(F.bround(F.avg(F.when(ok, F.col(m))), 2), F.lit(0.0)).alias(m)
             for m in METRICS]
    return parsed.groupBy(*(group or [])).agg(
        F.count(F.when(ok, 1)).alias("n_judged"), *means,
        F.when(F.count("*") == 0, F.lit(EMPTY_TEST_SET)).alias("error"))


def to_percent(value: Column) -> Column:
    """0..1 to percent with one decimal; null, NaN and non-numbers become 0.0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(
        F.bround(number * 100, 1))


def context_precision(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of precision@rank over the relevant ranks. ``verdicts``: keys, rank, verdict."""
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumn("_p", F.sum("verdict").over(upto) / F.col("rank"))
    return at.groupBy(*keys).agg(
        (F.sum(F.col("_p") * F.col("verdict")) / F.nullif(F.sum("verdict"), F.lit(0)))
        .alias("context_precision"))


def share_supported(verdicts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Share of supported statements; gives context recall and faithfulness."""
    return verdicts.groupBy(*keys).agg(F.avg("verdict").alias(name))


def answer_relevancy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine of a question to the questions generated from its answer.

    ``pairs``: keys, question_vector, generated_vector.
    """
    return pairs.groupBy(*keys).agg(
        F.avg(cosine(F.col("question_vector"), F.col("generated_vector")))
        .alias("answer_relevancy"))


def four_metrics(per_question: list[DataFrame], keys: list[str]) -> DataFrame:
    """Join per-question metric tables; questions missing a metric carry null."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), per_question)


def mean_metrics(per_question: DataFrame, group: list[str], strict: bool = False) -> DataFrame:
    """Percent means per configuration.

    A question without a valid score counts as 0. With ``strict`` one such question makes
    the whole mean 0. What the order of adding up leaves in the last digits is rounded off first,
    so means halfway between two percents come out the same however rows are dealt out.
    """
    def mean(name: str) -> Column:
        score = F.col(name).cast("double")
        bad = score.isNull() | F.isnan(score)
        plain = F.avg(F.when(bad, F.lit(0.0)).otherwise(score))
        if strict:
            plain = F.when(F.max(bad.cast("int")) == 0, plain)
        return to_percent(F.round(plain, _MEAN_DIGITS)).alias(name)

    return per_question.groupBy(*group).agg(
        F.count("*").alias("test_size"), *[mean(m) for m in METRICS])


def percent_details(per_question: DataFrame) -> DataFrame:
    """Per-question scores in percent."""
    return per_question.select(*[
        to_percent(F.col(c)).alias(c) if c in METRICS else F.col(c)
        for c in per_question.columns])


def word_overlap(pairs: DataFrame, wanted: str, given: str, name: str = "overlap") -> DataFrame:
    """Share of the distinct words of ``wanted`` that occur in ``given``; 0 without words."""
    a = F.array_distinct(tokenize(F.col(wanted)))
    b = F.array_distinct(tokenize(F.col(given)))
    return pairs.withColumn(name, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)))


def cut_per_config(hits: DataFrame, configs: list[tuple[str, int]]) -> DataFrame:
    """Hits of one retrieval at the largest ``top_k``, repeated for every configuration.

    Retrieval runs once; a configuration keeps the ranks up to its own ``top_k``.
    """
    if not configs:
        raise ValueError(NO_CONFIGS)
    table = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(k).alias("top_k"))
                      for name, k in configs])
    return (
        hits.withColumn("_c", F.explode(F.filter(table, lambda c: F.col("rank") <= c["top_k"])))
        .select(F.col("_c.config").alias("config"), F.col("_c.top_k").alias("top_k"), *hits.columns)
    )


def side_by_side(means: DataFrame, configs: list[str]) -> DataFrame:
    """One row per metric, one column per configuration."""
    long = means.select("config", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
        .alias("m")).select("config", "m.*")
    return long.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def evaluation_runs(scored: DataFrame) -> DataFrame:
    """(run, timestamp, kb_id, test_size, results[]): one nested row per archived run.

    ``scored``: run, timestamp, kb_id, config, top_k, query_id and the metrics. ``results``
    has one entry per configuration; per-question scores stay rows of their own, so the
    size of a run's row does not grow with its test set.
    """
    means = mean_metrics(scored, ["run", "timestamp", "kb_id", "config", "top_k"])
    result = F.struct(
        F.col("config").alias("name"), F.struct("top_k").alias("config"),
        F.struct(*METRICS).alias("metrics"))
    return means.groupBy("run", "timestamp", "kb_id").agg(
        F.max("test_size").alias("test_size"),
        F.array_sort(F.collect_list(result)).alias("results"))


def demo_questions(spark: SparkSession) -> DataFrame:
    """A small built-in test set: question_id, question, reference."""
    rows = [
        (1, "What is the use of splitting a text before it is indexed?",
         "Short passages fit a prompt and keep unrelated text out of the ranking."),
        (2, "When does keyword search find what vectors miss?",
         "Names and rare terms match exactly by keyword, vectors match by meaning."),
        (3, "How are two ranked lists merged without comparing scores?",
         "Reciprocal rank fusion adds one over a constant plus the rank in each list."),
        (4, "Why is the answer cache emptied when documents change?",
         "Cached answers may rest on text that is no longer there."),
        (5, "How does the reader know that a cited source is real?",
         "Numbers in the answer are mapped back to the retrieved passages."),
    ]
    return spark.createDataFrame(rows, "question_id long, question string, reference string")
