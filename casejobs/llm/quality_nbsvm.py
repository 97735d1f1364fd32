"""Quality classifier: a linear support vector machine over naive Bayes features.

Features are indicators of hashed n-grams (word unigrams and bigrams, byte trigrams). Each indicator is scaled by its
class log-count ratio; a hinge-loss linear model is fitted to the scaled indicators by dual coordinate descent. The
model is fitted on a bounded, hash-ordered sample of labelled rows; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks
from .sampling import hash_sample

WORD_BITS = 17
BYTE_BITS = 16
N_FEATURES = (1 << WORD_BITS) + (1 << BYTE_BITS)
#: Most labelled rows that the classifier is fitted on, and most distinct features that are taken of one of them.
MAX_TRAIN_DOCS = 6_000
FOLDS = 5
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers (with repeats) of each document of a chunk."""
    words = Words(raw, off)
    one = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    pair, pair_doc = words.grams(2)
    two = (pair >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        three = (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435769)) >> np.uint32(32 - BYTE_BITS)).astype(np.int32) + (1 << WORD_BITS)
    else:
        three = np.zeros(0, np.int32)
    at = np.searchsorted(pair_doc, np.arange(len(off)))
    for d in range(len(off) - 1):
        yield np.concatenate([one[words.first[d] : words.first[d + 1]], two[at[d] : at[d + 1]], three[off[d] : max(off[d], off[d + 1] - 2)]])


@dataclass
class Model:
    """``margin = weights[features].sum() / sqrt(features' count) + bias``; the score is its logistic calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _margins(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[x].sum() / np.sqrt(max(1, len(x))) + bias for x in rows])


#: Epochs at most; some dozens reach the tolerance.
MAX_EPOCHS = 10_000


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, tolerance: float = 0.1, seed: int = 0) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: weights of the *unscaled* indicators and the bias.

    Row i has the values scale[f] / sqrt(number of its features) for its features f, and a constant 1. Epochs go on until
    the projected gradients of one differ by no more than ``tolerance``; ``MAX_EPOCHS`` without that are an error.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([1.0 / np.sqrt(max(1, len(x))) for x in rows])
    square = np.array([(scale[x] ** 2).sum() * k * k + 1.0 for x, k in zip(rows, norm)])
    order = np.random.default_rng(seed)
    for _ in range(MAX_EPOCHS):
        least, most = np.inf, -np.inf
        for i in order.permutation(len(rows)):
            x = rows[i]
            v = scale[x] * norm[i]
            slope = y[i] * (w[x] @ v + bias) - 1.0
            projected = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            least, most = min(least, projected), max(most, projected)
            new = min(max(0.0, alpha[i] - slope / square[i]), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
        if most - least <= tolerance:
            return w * scale, bias
    raise RuntimeError(f"no fit within {MAX_EPOCHS} epochs")


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Fits on rows of distinct features and 0/1 labels; with one class only the score is that class's share."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(N_FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    calibrate = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~calibrate].tolist())) < 2 or len(set(labels[calibrate].tolist())) < 2:
        calibrate = np.zeros(len(rows), bool)
    train = [rows[i] for i in np.flatnonzero(~calibrate)]
    t = labels[~calibrate]
    count = np.zeros((2, N_FEATURES))
    for x, k in zip(train, t):
        count[k, x] += 1
    p = np.log((count + 1.0) / (count + 1.0).sum(axis=1, keepdims=True))
    y = np.where(t == 1, 1.0, -1.0)
    cost = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum())) * len(t)
    weights, bias = dual_coordinate_descent(train, y, p[1] - p[0], cost, seed=seed)
    use = np.flatnonzero(calibrate) if calibrate.any() else np.arange(len(rows))
    m, t = _margins([rows[i] for i in use], weights, bias), labels[use].astype(float)
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(100):  # Newton steps of the logistic calibration, with a small ridge
        q = 1.0 / (1.0 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((q - t) * m).sum() + 1e-2 * a, (q - t).sum()])
        h = (q * (1 - q)) + 1e-9
        step = np.linalg.solve(np.array([[(h * m * m).sum() + 1e-2, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]]), g)
        step = step / max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(weights.astype(np.float32), float(bias), float(a), float(b))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct features and labels of at most ``limit`` labelled ids outside the held-out fold, chosen by a hash.

    An id with several labels counts with the least, and an id with several texts with the one that has the least hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    known = hash_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), limit, F.col("doc_id")).collect()
    label = {r[0]: r[1] for r in known}
    ids = np.sort(np.array(list(label), dtype=np.int64))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_in(batch.column(0).cast(pa.int64()), pa.array(ids)))
            for row, end, raw, off in chunks(batch, "text"):
                found = [np.unique(x).astype(np.int32).tobytes() for x in _features(raw, off)]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).select(["doc_id", "place"]).columns, pa.array(found, pa.binary())], ["doc_id", "place", "features"])

    if not len(ids):
        return [], np.zeros(0, np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text", F.xxhash64("text").alias("place")).mapInArrow(take, f"doc_id {kind}, place bigint, features binary")
    got = got.groupBy("doc_id").agg(F.min_by("features", F.struct("place", "features")).alias("features")).toPandas().sort_values("doc_id")
    return [np.frombuffer(x, np.int32) for x in got["features"]], np.array([label[x] for x in got["doc_id"]], np.int64)


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.3).

    Null and empty texts get the score of a document without features. Rows with repeated or null ids are scored each
    for itself (a null id is not held out). Only the text enters a score; other columns are left out. Without labels
    every score is 0.5.
    """
    rows, known = training_rows(docs, labels, limit)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, known) if rows else Model(np.zeros(N_FEATURES, np.float32), 0.0, 0.0, 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        held = np.zeros(N_FEATURES, bool)
        for batch in batches:
            for row, end, raw, off in chunks(batch, "text"):
                out = np.zeros(end - row)
                for d, x in enumerate(_features(raw, off)):
                    held[x] = True
                    own = np.flatnonzero(held)
                    held[own] = False
                    out[d] = m.weights[own].sum(dtype=np.float64) / np.sqrt(max(1, len(own))) + m.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(m.score(out))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
