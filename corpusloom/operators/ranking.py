"""Top-k that stays bounded per task when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    rank: str = "rank", slices: int = 32) -> DataFrame:
    """Exact first ``k`` rows per group, ranked 1..k. ``order`` must end in a unique column.

    Each task cuts its own rows to ``k`` per group before the first shuffle. What is left of
    a group goes to as many tasks as there are slices, by the task it came from, is cut
    again, and the last step ranks at most ``k * slices`` rows per group. Any slicing gives
    the same answer, so a rerun task does no harm.
    """
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slice", F.spark_partition_id() % slices)
        .withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= k)
        .drop("_slice", "_rank")
        .withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)
    )
