"""Quality classifier: naive Bayes features into a linear support vector machine.

A document is a set of n-gram indicators: byte 3-grams, word 1- and 2-grams (letter case kept), each
hashed into ``DIM`` columns, and how often neighbouring words repeat each other (an indicator per level).
Each column is scaled by its class log-count ratio; dual coordinate descent then fits a linear
hinge-loss model on the scaled indicators, and a logistic curve turns margins of rows left out of that
fit into probabilities. The weight vector has a fixed size (``DIM`` floats), so scoring is one narrow
pass over whole texts.

The fit uses at most ``FIT_ROWS`` labelled rows, those whose ids have the smallest hash. Labels, lang,
source and doc_id are no inputs of a score.

Null texts count as empty; an empty text has the score of the intercept. Null labels or ids are left
out of the fit; a document labelled more than once counts by its majority (ties: 1). With one class or
no labels every score is that class's share (0.5 without labels). No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import empty_text, fold_of, mix, text_chunks, unused, word_hashes, word_spans

BITS = 17
DIM = 1 << BITS
FIT_ROWS = 8192
LEVELS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
THRESHOLD = 0.3
FOLDS = 5
_SHIFT = np.uint64(64 - BITS)


def features(array: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct columns of its indicators."""
    u = np.uint64
    seen = np.zeros(DIM, bool)
    for _, offsets, data in text_chunks(array):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, lower=False)
        with np.errstate(over="ignore"):
            wide = data.astype(u)
            grams = (mix((wide[:-2] << u(16) | wide[1:-1] << u(8) | wide[2:]) + u(1 << 24)) >> _SHIFT).astype(np.int64) if len(data) > 2 else np.zeros(0, np.int64)
            single = (words >> _SHIFT).astype(np.int64)
            double = (mix(words[:-1] * u(3) + words[1:] * u(7)) >> _SHIFT).astype(np.int64) if len(words) else single
        same = words[:-1] == words[1:]
        for k in range(len(offsets) - 1):
            a, b, s, e = int(first[k]), int(first[k + 1]), int(offsets[k]), int(offsets[k + 1])
            seen[grams[s:max(s, e - 2)]] = True
            seen[single[a:b]] = True
            if b - a > 1:
                seen[double[a:b - 1]] = True
                share = same[a:b - 1].mean()
                for level, least in enumerate(LEVELS):
                    if share > least:
                        seen[level] = True
            columns = np.flatnonzero(seen)
            seen[columns] = False
            yield columns


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, columns: np.ndarray) -> float:
        margin = float(self.weights[columns].sum() / np.sqrt(max(1, len(columns)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    count = [np.full(DIM, smooth), np.full(DIM, smooth)]
    for columns, label in zip(rows, labels):
        count[label][columns] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


class Scaled:
    """The ratios of each row's columns by its norm, formed at each visit: held for all rows they would take twice the room of the rows."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / np.sqrt(max(1, len(self.rows[i])))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray] | Scaled, signs: np.ndarray, costs: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum of cost * hinge over the dual, one variable at a time."""
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in map(values.__getitem__, range(len(rows)))])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = values[i]
            gradient = signs[i] * (w[rows[i]] @ own + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * own
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with smoothed targets and a small ridge."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    beta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1, rounds: int = 20, seed: int = 7) -> Model:
    """Train on indicator rows; every fifth row (in the given order) only calibrates."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 10 or share in (0.0, 1.0):
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    place = np.arange(len(rows)) % 5 == 0
    if len(set(labels[place].tolist())) < 2 or len(set(labels[~place].tolist())) < 2:
        place[:] = False
    own = np.flatnonzero(~place)
    ratio = log_count_ratios([rows[i] for i in own], labels[own])
    train = [rows[i] for i in own]
    signs = labels[own] * 2.0 - 1
    balance = np.where(signs > 0, 0.5 / (signs > 0).mean(), 0.5 / (signs < 0).mean())
    w, bias = dual_descent(train, Scaled(train, ratio), signs, cost * balance, rounds, seed)
    weights = (w * ratio).astype(np.float32)
    check = np.flatnonzero(place) if place.any() else own
    margins = np.array([weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias for i in check])
    slope, offset = _logistic(margins, labels[check])
    return Model(weights, bias, slope, offset)


def pack(columns: np.ndarray) -> bytes:
    """Sorted columns as compressed steps, about a third of their size: the driver receives all rows of the fit at once."""
    return zlib.compress(np.diff(columns, prepend=0).astype(np.int32).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int32), dtype=np.int32)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pack(c) for c in features(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(columns, pa.binary())], ["doc_id", "y", "columns"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> Model:
    """Fit on labelled documents outside the held-out fold. ``labels`` has doc_id and quality."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
        .filter(fold_of("doc_id", folds) != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "y", "text").mapInArrow(_columns, "doc_id long, y int, columns binary").collect()  # fit_rows rows
    found.sort(key=lambda r: (mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], r["columns"]))
    return fit([unpack(r["columns"]) for r in found], np.array([r["y"] for r in found], np.int64))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of quality 1 in ``column``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    whole = unused(docs.withColumn(column, F.lit(0.0)), "_whole_text")
    with_text = docs.withColumn(whole, empty_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(whole)
            scores = [held.value.score(c) for c in features(batch.column(place))]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != place]
            names = [n for i, n in enumerate(batch.schema.names) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*names, column])

    return with_text.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", empty_text().alias("text"))
    model = train(docs, labels, folds=folds)
    return scored(own, model).select(
        "doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
