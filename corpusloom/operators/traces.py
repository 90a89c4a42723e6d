"""Summaries of agent step logs and of span latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.operators.ranking import top_k_per_group
from corpusloom.session import materialize

# Step limit and the reply without an answer.
MAX_STEPS = 8
NO_ANSWER = "抱歉，Agent 没有生成回答。"


def summarize_runs(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """(session, steps, answer) from session, step, node, has_tool_calls, content.

    Steps are model calls, at most ``max_steps``. The answer is the last of them without
    tool calls; an empty one becomes the fixed reply.
    """
    calls = top_k_per_group(steps.filter(F.col("node") == "call_model"), ["session"],
                            [F.col("step")], max_steps, "_n")
    final = F.when(~F.col("has_tool_calls"), F.struct("step", "content"))
    ran = calls.groupBy("session").agg(
        F.count("*").alias("steps"), F.max(final)["content"].alias("answer"))
    return steps.select("session").distinct().join(ran, "session", "left").select(
        "session", F.coalesce("steps", F.lit(0)).alias("steps"),
        F.when(F.length("answer") > 0, F.col("answer")).otherwise(F.lit(NO_ANSWER))
        .alias("answer"))


#: Ranks of the quantile sketch are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def latency_summary(spans: DataFrame, group: list[str], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Count, mean and exact discrete quantiles of ``ms`` per group, in two passes.

    The first pass makes counts and a mergeable quantile sketch per group. Its ranks are known to
    1 / ACCURACY, so two values around each quantile bracket it for sure. The second pass counts
    what lies below a bracket, and each value inside, before anything is shuffled; the inside is
    four parts in ACCURACY of a group's spans, and the value at the rank is picked there.
    """
    values = spans.filter(F.col("ms").isNotNull()).select(*group, F.col("ms").cast("double").alias("ms"))
    margin = 2 / ACCURACY
    probes = [min(1.0, max(0.0, q + side * margin)) for q in quantiles for side in (-1, 1)]
    totals = materialize(values.groupBy(*group).agg(
        F.count("*").alias("n_spans"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("least"),
        F.max("ms").alias("most"), F.percentile_approx("ms", probes, ACCURACY).alias("marks")), "latency-totals")
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("n_spans") * q)).alias("target"),
        (F.get("marks", F.lit(2 * i)) if q - margin > 0 else F.col("least")).alias("low"),
        (F.get("marks", F.lit(2 * i + 1)) if q + margin < 1 else F.col("most")).alias("high"))
        for i, q in enumerate(quantiles)])
    wanted = totals.select(*[F.col(g).alias(f"_{g}") for g in group], F.explode(brackets).alias("w")).select(
        *[f"_{g}" for g in group], "w.*")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.when(F.col("ms") >= F.col("low"), F.col("ms"))
    counted = values.join(wanted, same).filter(F.col("ms") <= F.col("high")).groupBy(
        *group, "i", "target", inside.alias("ms")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("ms")))
    found = counted.withColumn("upto", upto).filter(
        (F.col("target") <= F.col("upto")) & (F.col("target") > F.col("upto") - F.col("n")))
    wide = found.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(*[
        F.max(F.when(F.col("i") == i, F.col("ms"))).alias(f"p{round(q * 100)}_ms")
        for i, q in enumerate(quantiles)])
    return totals.drop("least", "most", "marks").join(wide, same).drop(*[f"_{g}" for g in group])
