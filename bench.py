"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from corpusloom.plans import bindings
from corpusloom.plans.registry import QUERIES
from corpusloom.session import build_session, remove_stored

# Indexes first: each is built once and read by the queries after it.
INDEXES = {
    "index_chunks": bindings.chunks,
    "index_terms": lambda spark, sf: bindings.corpus_lexicon(spark, sf)[0],
    "index_terms_by_kb": lambda spark, sf: bindings.kb_lexicon(spark, sf)[0],
    "index_slots": bindings.corpus_slot_weights,
}
HEADLINE = (
    "chunk_windows", "window_sweep", "word_tokens", "store_append", "bulk_import",
    "kb_statistics", "bm25_top_k", "bm25_scores", "bm25_padded", "dense_text_top_k", "dense_top_k",
    "approximate_top_k", "hybrid_search", "answer_questions", "chat_prompts", "cited_sources",
    "cache_lookup", "cache_lookup_large", "cache_fill", "judge_means", "metric_means", "config_comparison",
    "keyword_search", "line_preview", "directory_listing", "path_policy_read", "run_summaries",
    "latency_summary", "stream_ingest", "stream_cache_lookup",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus), spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, build in INDEXES.items():
        began = time.perf_counter()
        build(spark, sf)
        times[name] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    remove_stored(spark)
    spark.stop()


if __name__ == "__main__":
    main()
