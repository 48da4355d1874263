"""Quality classifier: linear support vectors on Naive Bayes features.

A text's features are indicators of the n-grams it has: words, pairs of words,
byte trigrams and repeats of a word by the next 1, 2, 4 or 8 words, hashed to a fixed number of places.  The log-count ratio of the two
classes is counted over all labelled training rows; indicators are scaled by it, and a
linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of
these rows (``fit_rows``).  Margins become scores from 0 to 1 by a logistic curve
fitted to the sample.  The model is two arrays of ``PLACES`` numbers, whatever the
input's size.

Labels, languages, sources and ids are never inputs of a score.  Rows whose
crc32(id as text) mod 4 is 2 are held out of all training.

Defined cases: a null text is empty and gets the score of a text without n-grams;
labels that are null or belong to no document are not used; an id labelled
differently twice counts once for each label; with one class only, or no label, every score is that
class's share (0.5 without labels); repeated rows get equal scores; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import U64, WordHashes, column, mix, raw

PLACES = 1 << 18
FIT_ROWS = 6000
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 12


class Features:
    """Sorted distinct places of a text's n-grams."""

    def __init__(self):
        self.hashes = WordHashes(200_000)

    def of(self, text: bytes) -> np.ndarray:
        words = self.hashes.of(text.split())[:, 0] if text else np.empty(0, U64)
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        with np.errstate(over="ignore"):
            tri = np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(U64) if len(b) > 2 else np.empty(0, U64)
            again = np.concatenate([[False], words[1:] == words[:-1], [False]]) if len(words) else np.zeros(1, bool)
            turns = np.flatnonzero(again[1:] != again[:-1])
            longest = int((turns[1::2] - turns[::2]).max(initial=0))
            stutter = np.array([n for n in (1, 2, 4, 8) if n <= longest], U64)
            found = np.concatenate([mix(stutter), mix(tri + U64(1 << 32)), mix(words + U64(2)), mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:] + U64(3))])
        return np.unique(found >> U64(64 - 18)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame) -> DataFrame:
    """Distinct (id, quality) that training may see."""
    return (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
            .where(F.col("_id").isNotNull() & F.col("_quality").isin(0, 1) & ~held_out(F.col("_id"))).distinct())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, seen = Features(), np.zeros((2, PLACES), np.int64)
    n = np.zeros(2, np.int64)
    for b in batches:
        for text, q in zip(raw(b), column(b, "_quality").to_pylist()):
            seen[q, features.of(text)] += 1
            n[q] += 1
    at = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[0, at], n[0])), pa.array(np.append(seen[1, at], n[1]))],
                                     names=["place", "low", "high"])


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of each place over all labelled rows, and the number of rows of each class; at most PLACES rows reach the driver."""
    found = (labelled.mapInArrow(_counts, "place long, low long, high long").groupBy("place")
             .agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toArrow())
    at, low, high = (found.column(c).to_numpy() for c in ("place", "low", "high"))
    n = np.array([low[at < 0].sum(), high[at < 0].sum()], np.int64)
    seen = np.zeros((2, PLACES))
    seen[0, at[at >= 0]], seen[1, at[at >= 0]] = low[at >= 0], high[at >= 0]
    p = np.log((seen + SMOOTHING) / (seen.sum(1, keepdims=True) + SMOOTHING * PLACES))
    return np.where(seen.sum(0) > 0, p[1] - p[0], 0.0), n


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of min |w|^2/2 + cost * sum of hinge losses; rows are unit vectors of scaled indicators."""
    w = np.zeros(PLACES + 1)
    bias = PLACES
    values = [_scaled(r, ratio) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + w[bias]) - 1.0
            after = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if after != alpha[i]:
                step = (after - alpha[i]) * y[i]
                w[r] += step * v
                w[bias] += step
                worst = max(worst, abs(after - alpha[i]))
                alpha[i] = after
        if worst < 1e-3:
            break
    return w


def _scaled(places: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[places]
    return v / max(np.sqrt(v @ v), 1e-12)


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve through the margins, by Newton steps with a small prior."""
    a, b = 2.0, 0.0
    t = np.where(y > 0, 1 - 1 / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ margins ** 2 + 1e-3, s @ margins], [s @ margins, s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [g @ margins + 1e-3 * (a - 2.0), g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    def __init__(self, ratio, weights, slope, offset, constant=None):
        self.ratio, self.weights = ratio.astype(np.float32), weights
        self.slope, self.offset, self.constant = slope, offset, constant

    def score(self, places: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        margin = self.weights[places] @ _scaled(places, self.ratio) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Ratios over all labelled rows of ``docs``; descent on about ``fit_rows`` of them, chosen by a hash of the id."""
    known = training_labels(labels)
    n = known.count()
    own = docs.select(F.col("doc_id").alias("_id"), "text")
    ratio, seen = log_count_ratios(own.join(known.hint("merge"), "_id").select("text", "_quality"))
    if not seen.all():
        return Model(ratio, np.zeros(PLACES + 1), 1.0, 0.0, float(seen[1] / seen.sum()) if seen.sum() else 0.5)
    part = min(1.0, fit_rows / max(n, 1))
    chosen = known.where(F.xxhash64("_id").cast("double") / 2.0 ** 63 <= 2 * part - 1)
    return _fit_on(own.join(F.broadcast(chosen), "_id").select("_id", "text", "_quality"), ratio)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        yield pa.RecordBatch.from_arrays([column(b, "_id"), column(b, "_quality"), pa.array([features.of(t).astype(np.int32) for t in raw(b)], pa.list_(pa.int32()))],
                                         names=["_id", "_quality", "places"])


def _fit_on(sample: DataFrame, ratio: np.ndarray) -> Model:
    got = sample.mapInArrow(_places, "_id long, _quality int, places array<int>").toArrow()
    lists = got.column("places").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    ids, quality = got.column("_id").to_numpy(), got.column("_quality").to_numpy()
    order = np.lexsort((ends[1:] - ends[:-1], quality, ids))  # whatever order tasks end in
    places = [flat[ends[i]:ends[i + 1]] for i in order]
    y = np.where(quality[order] == 1, 1.0, -1.0)
    inner = np.arange(len(y)) % 5 != 0  # the logistic curve is fitted to margins of rows that the descent has not seen
    w = dual_coordinate_descent([places[i] for i in np.flatnonzero(inner)], y[inner], ratio)
    rest = np.flatnonzero(~inner)
    margins = np.array([w[places[i]] @ _scaled(places[i], ratio) + w[-1] for i in rest])
    slope, offset = logistic(margins, y[rest])
    return Model(ratio, w.astype(np.float32), slope, offset)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), Model(**sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([m.score(features.of(t)) for t in raw(b)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
