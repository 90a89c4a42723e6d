"""BM25 over chunks: statistics, scores, top hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import tokenize
from corpusloom.operators.ranking import top_k_per_group
from corpusloom.operators.scan import BLOCK_BYTES, row_slices, scan_top_k
from corpusloom.session import materialize

# Saturation, length weight, floor for negative term weights.
K1 = 1.5
B = 0.75
EPSILON = 0.25


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Add ``tokens``, unless the chunks were stored with them.

    Statistics, vectors and every search read tokens; storing them once saves each of these
    the regular expression.
    """
    if "tokens" in chunks.columns:
        return chunks
    return chunks.withColumn("tokens", tokenize(F.col("content")))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """(kb_id, n_chunks, avg_len): how many chunks and how many tokens each has on average."""
    return with_tokens(chunks).groupBy("kb_id").agg(
        F.count("*").alias("n_chunks"), F.avg(F.size("tokens")).alias("avg_len"))


def term_statistics(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """(kb_id, term, df, idf): chunk frequency and weight of every term.

    ``idf = ln(N - df + 0.5) - ln(df + 0.5)``; negative weights become a quarter of the mean
    weight over the kb's vocabulary. Terms are reduced to one count per task before the
    shuffle, so a term that occurs everywhere costs no more than a rare one.
    """
    counted = materialize(
        with_tokens(chunks)
        .select("kb_id", F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("kb_id", "term").agg(F.count("*").alias("df")), "term-counts")
    return weigh_terms(counted, corpus)


def weigh_terms(counted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(kb_id, term, df, idf) from stored (kb_id, term, df)."""
    raw = counted.join(corpus, "kb_id").select(
        "kb_id", "term", "df",
        (F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("kb_id").agg(F.avg("raw").alias("mean_idf"))
    return raw.join(mean, "kb_id").select(
        "kb_id", "term", "df",
        F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw"))
        .alias("idf"))


def question_weights(queries: DataFrame, terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, kb_id, term, weight, avg_len): a repeated question term counts repeatedly."""
    # Stored first: with its size known, the vocabulary is scanned rather than shuffled.
    asked = materialize(
        queries.select("query_id", "kb_id", F.explode(tokenize(F.col("text"))).alias("term"))
        .groupBy("query_id", "kb_id", "term").agg(F.count("*").alias("qf")), "question-terms")
    return (
        asked.join(terms, ["kb_id", "term"]).join(corpus, "kb_id")
        .select("query_id", "kb_id", "term",
                (F.col("qf") * F.col("idf")).alias("weight"), "avg_len")
    )


def pack_weights(table: pa.Table) -> dict:
    out = {}
    frame = table.to_pandas()
    for kb, rows in frame.groupby("kb_id", sort=False):
        ids, q_at = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        vocab, t_at = np.unique(rows["term"].to_numpy(dtype=object).astype(str),
                                return_inverse=True)
        order = np.argsort(t_at, kind="stable")
        out[kb] = {
            "ids": ids.tolist(), "vocab": pa.array(vocab.tolist(), pa.string()),
            "first": np.searchsorted(t_at[order], np.arange(len(vocab) + 1)),
            "q": q_at[order], "weight": rows["weight"].to_numpy()[order],
            "avg_len": float(rows["avg_len"].iloc[0]),
        }
    return out


def _score_terms(entry: dict, kb: str, batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple]:
    lists = batch.column("tokens").take(pa.array(rows))
    n_terms, n_q = len(entry["vocab"]), len(entry["ids"])
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    term_at = pc.index_in(lists.flatten(), value_set=entry["vocab"]).fill_null(-1).to_numpy(
        zero_copy_only=False)
    row_at = np.repeat(np.arange(len(rows)), lengths)
    for part in row_slices(len(rows), n_q):
        low, high = ends[part.start], ends[part.stop]
        known = term_at[low:high] >= 0
        code = (row_at[low:high][known] - part.start) * n_terms + term_at[low:high][known]
        pair, tf = np.unique(code, return_counts=True)
        row, term = pair // n_terms, pair % n_terms
        size = lengths[part][row]
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / entry["avg_len"]))
        fan = entry["first"][term + 1] - entry["first"][term]
        start = np.repeat(entry["first"][term] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan)
        at = start + np.arange(fan.sum())
        cell = np.repeat(row, fan) * n_q + entry["q"][at]
        n = part.stop - part.start
        scores = np.bincount(cell, entry["weight"][at] * np.repeat(gain, fan), n * n_q)
        hits = np.bincount(cell, minlength=n * n_q)
        yield part, scores.reshape(n, n_q), hits.reshape(n, n_q) > 0


def score_all(entry: dict, kb: str, batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple]:
    for part, scores, _ in _score_terms(entry, kb, batch, rows):
        yield part, scores, None


def bm25_top_k(chunks: DataFrame, queries: DataFrame, terms: DataFrame, corpus: DataFrame,
               k: int = 10, pad_zero: bool = False,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best chunks per question within its kb: query_id, chunk_id, score, rank.

    Only chunks sharing a term with the question are ranked. With ``pad_zero`` every other
    chunk of the kb is ranked too, at score 0. That takes no pair of question and chunk: zeros
    are the same for all questions, so a kb's first 2k chunks by id are enough to fill any
    list of k. Only kbs with a term weight of 0 or less, where a real hit may rank below a
    zero, have all their pairs scored; these are kbs whose terms mostly stand in every chunk.
    """
    weights = materialize(question_weights(queries, terms, corpus), "question-weights")
    rows = with_tokens(chunks).select("kb_id", F.col("chunk_id").alias("row_id"), "tokens")
    size = F.length("term") + 48

    def scan(these: DataFrame, asked: DataFrame, most: int, score) -> DataFrame:
        return scan_top_k(these, asked, size, most, pack_weights, score, block_bytes)

    if not pad_zero:
        return scan(rows, weights, k, _score_terms).withColumnRenamed("row_id", "chunk_id")
    # A term no text has brings in questions without any known term.
    asked = materialize(weights.unionByName(queries.join(corpus, "kb_id").select(
        "query_id", "kb_id", F.lit("").alias("term"), F.lit(0.0).alias("weight"), "avg_len")),
        "padded-weights")
    flat = terms.filter("idf <= 0").select("kb_id").distinct()
    usual, odd = (asked.join(flat, "kb_id", how) for how in ("left_anti", "left_semi"))
    first = top_k_per_group(rows.select("kb_id", "row_id"), ["kb_id"], [F.col("row_id")], 2 * k)
    zeros = scan(rows.join(first, ["kb_id", "row_id"], "left_semi"), usual, 2 * k, score_all)
    found = (
        scan(rows, usual, k, _score_terms).unionByName(zeros.filter("score = 0"))
        .unionByName(scan(rows, odd, k, score_all))
        .select("query_id", "row_id", "score").distinct())
    return top_k_per_group(found, ["query_id"], [F.desc("score"), F.col("row_id")], k).select(
        "query_id", F.col("row_id").alias("chunk_id"), "score", "rank")
