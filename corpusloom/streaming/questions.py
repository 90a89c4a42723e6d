"""A stream of questions answered from the cache where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.answer_cache import THRESHOLD, CacheStore, lookup


def start_lookup(questions: DataFrame, cache: DataFrame | CacheStore, target: str, checkpoint: str,
                 threshold: float = THRESHOLD, trigger: dict | None = None) -> StreamingQuery:
    """Write every question with its cached answer, or nulls, below ``target``.

    With a ``CacheStore`` every batch takes the version that is current when it starts, so answers
    published meanwhile are found by the next batch, and removed ones no more.
    Each batch overwrites its own ``batch_id`` folder, so a batch that runs again after a
    failure leaves the same rows.
    """
    def answer(batch: DataFrame, batch_id: int) -> None:
        live = cache.current() if isinstance(cache, CacheStore) else cache
        lookup(live, batch, threshold).write.mode("overwrite").parquet(
            f"{target}/batch_id={batch_id}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
