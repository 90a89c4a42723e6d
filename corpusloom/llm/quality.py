"""A quality classifier by co-training on two views of a document.

One classifier sees the text's content, the other what is known about the page: source,
language, length. Both are fitted on a bounded sample of labelled documents. Over some rounds
each marks the documents without a label that it is sure about, all of the table's, and these
join the other's training rows. The views' features are stored once, and a Newton step is a pass
over them: tasks add up gradients and curvatures, of which the driver gets the sums, as many
numbers as a view has pairs of features. At the end each view's log odds are calibrated on
labelled documents kept apart, the views are added up, and every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, LongType, StructField,
                               StructType)

from corpusloom.llm.common import forget_kept, list_array, mix64, small_slices, string_buffers, word_hashes
from corpusloom.session import materialize

#: Labelled documents that are fitted on, at most; everything else covers all documents.
MAX_LABELLED = 20_000
ROUNDS = 3
STEPS = 2
SURE = 0.97
_EDGE = np.log(SURE / (1 - SURE))
#: A pseudo-label weighs this much at most, and all of them together no more than the labels.
PSEUDO_WEIGHT = 0.25
HASHED_WORDS = 32
HASHED_SOURCES = 64
HASHED_LANGS = 16

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n",
            ".,;:?'\"()-", "|", "!", "#$%&*@^~=+<>{}[]\\/_`")
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _chars]] = _i


def _by_row(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=n).astype(np.float64)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of numbers per text: make-up of its characters, repetition, hashed words."""
    starts, body = string_buffers(column)
    n = len(starts) - 1
    part = body[starts[0]:starts[-1]]
    sizes = np.diff(starts)
    chars = np.bincount(
        np.repeat(np.arange(n), sizes) * (len(_CLASSES) + 1) + _CLASS_OF[part],
        minlength=n * (len(_CLASSES) + 1)).reshape(n, -1) / np.maximum(1, sizes)[:, None]
    owner, words = word_hashes(body, starts)
    count = _by_row(owner, n)
    safe = np.maximum(1, count)
    keys = mix64(words ^ mix64(owner.astype(np.uint64)))
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    distinct = _by_row(owner[order][fresh], n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeated = _by_row(owner[again], n) / safe
    hashed = np.bincount(owner * HASHED_WORDS + (words % np.uint64(HASHED_WORDS)).astype(np.int64),
                         minlength=n * HASHED_WORDS).reshape(n, -1) / safe[:, None]
    share = chars[:, [1, 2, 6, 7, 8]]
    # Steps as well as shares: a little of a mark is normal, much of it is not.
    steps = [share > x for x in (0.002, 0.02, 0.08, 0.25)]
    repeats = np.column_stack([repeated > x for x in (0.02, 0.1, 0.3)])
    log_count = np.log1p(count)
    return np.column_stack([
        chars, *steps, log_count, sizes / safe, repeated, repeats, distinct / safe,
        np.log(np.maximum(1, distinct)) / np.maximum(0.7, log_count), hashed]).astype(np.float64)


def meta_features(columns: list[pa.Array]) -> np.ndarray:
    """Source and language as hashed indicators, length as steps of its logarithm."""
    source, lang, length = columns
    n = len(source)

    def indicator(values: pa.Array, width: int) -> np.ndarray:
        out = np.zeros((n, width))
        slots = [0 if v is None else 1 + zlib.crc32(v.encode()) % (width - 1)
                 for v in values.to_pylist()]
        out[np.arange(n), slots] = 1
        return out

    size = np.array([v or 0 for v in length.to_pylist()], np.float64)
    log_size = np.log1p(np.maximum(0, size))
    steps = np.column_stack([log_size > x for x in range(3, 13)])
    return np.column_stack([indicator(source, HASHED_SOURCES), indicator(lang, HASHED_LANGS),
                            log_size, steps]).astype(np.float64)


@dataclass
class Logistic:
    """Logistic regression on standardised columns by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def blank(x: np.ndarray) -> Logistic:
        """No weights yet; columns are standardised as in ``x``."""
        scale = x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        return Logistic(x.mean(axis=0), scale, np.zeros(x.shape[1] + 1))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Logistic:
        model = Logistic.blank(x)
        for _ in range(25):
            model, moved = model.step(*model.slopes(x, y))
            if moved < 1e-6:
                break
        return model

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, curvature) of the rows' loss."""
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray, ridge: float = 1.0) -> tuple[Logistic, float]:
        """The model after a Newton step, and the largest move. Weights are rounded, so sums that
        differ in their last digits only give the same model."""
        penalty = np.full(len(gradient), ridge)
        penalty[0] = 1e-6
        move = np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * self.weights)
        move *= min(1.0, 5 / max(1e-9, np.abs(move).max()))
        return Logistic(self.mean, self.scale, np.round(self.weights - move, 7)), float(np.abs(move).max())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


@dataclass
class View:
    """A view's classifier, what turns its log odds into true ones, and whether it is as right
    as it says about labelled rows kept apart: only then it marks rows for the other view."""

    model: Logistic
    calibration: Logistic
    trusted: bool

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.log_odds(self.model.log_odds(x)[:, None])


@dataclass
class Model:
    views: list[View]
    prior: float

    def scores(self, inputs: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated probability of each view, then of both together."""
        odds = [v.log_odds(x) for v, x in zip(self.views, inputs)]
        both = sum(odds) - self.prior * (len(odds) - 1)
        return [1 / (1 + np.exp(-o)) for o in (*odds, np.clip(both, -30, 30))]


def told(views: list[View], x: np.ndarray) -> np.ndarray:
    """What the first of a view's rounds that is sure says of each row, nan where none is."""
    marks = np.full(len(x), np.nan)
    for view in views:
        if view.trusted:
            odds = view.model.log_odds(x)
            marks = np.where(np.isnan(marks) & (np.abs(odds) >= _EDGE), (odds > 0).astype(float), marks)
    return marks


def pseudo_slopes(history: list[list[View]], now: list[Logistic],
                  x: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per view: rows that the other view has marked, and the slopes of their loss."""
    out = []
    for i, view in enumerate(now):
        marks = told([models[1 - i] for models in history], x[1 - i])
        sure = ~np.isnan(marks)
        out.append((float(sure.sum()), *view.slopes(x[i][sure], marks[sure])))
    return out


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool) -> Model | None:
    """Fit both views; None unless both the fitted and the held-out labels have both classes.

    ``pool(history, now)`` gives the sums of ``pseudo_slopes`` over all rows without a label.
    """
    apart = np.arange(len(y)) % 4 == 3
    if any(np.sum(y[part] == c) == 0 for part in (apart, ~apart) for c in (0, 1)):
        return None
    own, own_y = [x[~apart] for x in labelled], y[~apart]
    views = [Logistic.fit(x, own_y) for x in own]

    def calibrated(view: Logistic, x: np.ndarray) -> View:
        odds = view.log_odds(x[apart])
        sure = np.abs(odds) >= _EDGE
        right = ((odds > 0) == (y[apart] == 1))[sure]
        return View(view, Logistic.fit(odds[:, None], y[apart]), bool(len(right) and right.mean() >= SURE))

    def loss(view: View, x: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * view.log_odds(x[apart])).mean())

    best = [calibrated(v, x) for v, x in zip(views, labelled)]
    history = []
    for _ in range(ROUNDS):
        history.append(best)
        for _ in range(STEPS):
            new = []
            for view, x, (n, gradient, curvature) in zip(views, own, pool(history, views)):
                share = min(PSEUDO_WEIGHT, len(own_y) / max(1.0, n))
                g, c = view.slopes(x, own_y)
                new.append(view.step(g + share * gradient, c + share * curvature)[0])
            views = new
        # A round that serves the labels kept apart clearly worse is undone.
        now = [calibrated(v, x) for v, x in zip(views, labelled)]
        best = [n if loss(n, x) <= 1.1 * loss(b, x) + 1e-3 else b for n, b, x in zip(now, best, labelled)]
        views = [b.model for b in best]
    share = y[apart].mean()
    return Model(best, float(np.log(share / (1 - share))))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [text_features(batch.column("text")), meta_features([batch.column(c) for c in ("source", "lang", "length")])]


def _featured(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for rows in small_slices(batch, size=1 << 20):
                lists = [list_array(pa.array(x.astype(np.float32).ravel()),
                                    np.arange(len(x) + 1) * x.shape[1]) for x in _views(rows)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), *lists], schema=out)

    return run


def _matrices(batch) -> list[np.ndarray]:
    """Both views' stored features of some rows."""
    out = []
    for name in ("text_view", "meta_view"):
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64))
    return out


def _slopes(history: list, now: list, out: pa.Schema):
    """mapInArrow: a task's sums of ``pseudo_slopes`` as (place, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        total = None
        for batch in batches:
            for at in range(0, len(batch), 2048):
                found = pseudo_slopes(history, now, _matrices(batch.slice(at, 2048)))
                flat = np.concatenate([np.concatenate([[n], g, c.ravel()]) for n, g, c in found])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], schema=out)

    return run


def _pool(features: DataFrame):
    """For ``co_train``: sums over the stored rows that are not among the labelled."""
    kind = StructType([StructField("place", LongType()), StructField("value", DoubleType())])
    arrow = features.sparkSession.createDataFrame([], kind).toArrow().schema

    def sums(history: list, now: list) -> list[tuple]:
        rows = features.filter("label is null").select("text_view", "meta_view").mapInArrow(
            _slopes(history, now, arrow), kind).groupBy("place").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(sum(1 + len(v.weights) * (1 + len(v.weights)) for v in now))
        for row in rows:
            flat[row.place] = row.value
        out, at = [], 0
        for view in now:
            d = len(view.weights)
            part = flat[at:at + 1 + d + d * d]
            out.append((part[0], part[1:1 + d], part[1 + d:].reshape(d, d)))
            at += len(part)
        return out

    return sums


def _scores(model: Model, inputs: list[np.ndarray]) -> list[np.ndarray]:
    # Rounded, so that how rows fall into batches never shows.
    return [np.round(s, 6) for s in model.scores(inputs)]


def _scored(model: Model, threshold: float, out: pa.Schema):
    """mapInArrow: stored features to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for at in range(0, len(batch), 2048):
                rows = batch.slice(at, 2048)
                scores = _scores(model, _matrices(rows))
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), *map(pa.array, scores), pa.array(scores[-1] >= threshold)], schema=out)

    return run


def _good(model: Model, threshold: float, n_columns: int, text_at: int, out: pa.Schema):
    """mapInArrow: rows with source, language and length behind them, to the good rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            told_by = pa.RecordBatch.from_arrays(
                [batch.column(text_at), *batch.columns[n_columns:]], ["text", "source", "lang", "length"])
            at = 0
            for rows in small_slices(told_by, 0, 1 << 20):
                good = pa.array(_scores(model, _views(rows))[-1] >= threshold)
                own = batch.slice(at, len(rows))
                at += len(rows)
                yield pa.RecordBatch.from_arrays(own.columns[:n_columns], schema=out).filter(good)

    return run


def _told(docs: DataFrame, text_col: str, source_col: str, lang_col: str, length_col: str) -> list:
    """The columns that the views are made from; missing ones are null."""

    def column(name: str, kind: str):
        found = F.col(f"`{name}`") if name in docs.columns else F.lit(None)
        return found.cast(kind)

    return [F.coalesce(F.col(text_col), F.lit("")).alias("text"), column(source_col, "string").alias("source"),
            column(lang_col, "string").alias("lang"), column(length_col, "long").alias("length")]


def _arrow(spark, schema: StructType) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", *, source_col: str = "source", lang_col: str = "lang",
                length_col: str = "n_chars") -> tuple[Model | None, DataFrame]:
    """(the model, stored features of all rows); see ``classify_quality``."""
    spark = docs.sparkSession
    id_field = StructField("id", docs.schema[id_col].dataType)
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("long").alias("label")).filter(
        "of is not null and label in (0, 1)").groupBy("of").agg(F.max("label").alias("label"))
    least = F.md5(F.col("of").cast("string"))
    # Bounded by MAX_LABELLED rows, so it may be broadcast.
    chosen = F.broadcast(known.orderBy(least, "of").limit(MAX_LABELLED))
    whole = docs.select(F.col(id_col).alias("id"), *_told(docs, text_col, source_col, lang_col, length_col))
    kind = StructType([id_field, StructField("label", LongType()),
                       StructField("text_view", ArrayType(FloatType())),
                       StructField("meta_view", ArrayType(FloatType()))])
    features = materialize(whole.join(chosen, F.col("id") == F.col("of"), "left").drop("of").mapInArrow(
        _featured(_arrow(spark, kind)), kind), "quality-features")
    # A row for each labelled id: bounded by MAX_LABELLED, however often an id is repeated.
    rows = features.filter("label is not null").groupBy("id").agg(
        F.min(F.struct("label", "text_view", "meta_view")).alias("one")).select(
        F.md5(F.col("id").cast("string")).alias("turn"), "id", "one.*").orderBy("turn", "id").toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    model = co_train(_matrices(rows), label, _pool(features)) if len(label) else None
    return model, features


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", label_col: str = "quality", *,
                     source_col: str = "source", lang_col: str = "lang",
                     length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, p_text, p_meta, score, kept.

    ``labels`` has the id and a label of 1 for good and 0 for bad; null labels are ignored and
    the largest of several counts. At most MAX_LABELLED of them, those with the least hash of
    their id, are fitted on, one row of each id; a quarter of these calibrates. All other rows
    serve for pseudo-labels. If the labels lack a class, nothing can be learnt: every score is null and
    everything is kept. Null texts are empty; null, missing or odd metadata is a value of its own.
    Rows that repeat an id are scored each by its own text. Columns of other names are not looked
    at; an empty table gives an empty result.
    """
    names = {"source_col": source_col, "lang_col": lang_col, "length_col": length_col}
    model, features = fit_quality(docs, labels, id_col, text_col, label_col, **names)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col(id_col), nothing.alias("p_text"), nothing.alias("p_meta"),
                           nothing.alias("score"), F.lit(True).alias("kept"))
    scored = StructType([features.schema["id"], *(StructField(x, DoubleType()) for x in ("p_text", "p_meta", "score")),
                         StructField("kept", BooleanType())])
    return features.mapInArrow(_scored(model, threshold, _arrow(docs.sparkSession, scored)), scored).withColumnRenamed(
        "id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", *, source_col: str = "source", lang_col: str = "lang",
              length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``classify_quality`` rejects: one more pass, no join."""
    names = {"source_col": source_col, "lang_col": lang_col, "length_col": length_col}
    model, _ = fit_quality(docs, labels, id_col, text_col, label_col, **names)
    if model is None:
        return docs
    columns = docs.columns
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
                       *_told(docs, text_col, *names.values())[1:])
    kind = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return wide.mapInArrow(_good(model, threshold, len(columns), columns.index(text_col),
                                 _arrow(docs.sparkSession, kind)), kind).toDF(*columns)
