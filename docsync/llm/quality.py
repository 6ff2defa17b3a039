"""Text quality by ordinal regression with cumulative links.

For graded ratings y in 0..K-1: P(y > k) = sigmoid(w.x - t_k) with one weight vector shared by
all grades and ordered thresholds t_0 < t_1 < .... The features are hashed: words, the shapes
of words (runs of lower case, upper case, digits and each punctuation mark) and pairs of
neighbouring shapes, each as a share of the text's words, so a score does not grow with length.

Fitted on at most ``ROWS`` rated texts; every text is scored whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.sample import bounded_sample, keep_rows
from docsync.llm.words import LOWER, WHITE_SPACE, chunks, hash_words, mix, utf8

ROWS = 4000
BUCKETS = 1 << 16
STEPS, RATE, PENALTY = 150, 0.3, 1e-4
SCALE = 10.0
# A text is rejected when the chance of the top grade is below this.
LEAST_TAIL = 0.3

# Byte to the class of its character; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[0x80:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, three per word, and the n + 1 offsets of the texts."""
    words, at = hash_words(LOWER[data], bounds, WHITE_SPACE)
    shape = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | WHITE_SPACE[shape[1:]]
    keep[bounds[:-1][bounds[:-1] < len(data)]] = True
    new = np.concatenate(([0], np.cumsum(keep)))[bounds]
    shapes, _ = hash_words(shape[keep], new, WHITE_SPACE)
    pairs = shapes.copy()
    pairs[1:] += np.uint64(3) * shapes[:-1]
    firsts = at[:-1][at[:-1] < len(pairs)]
    pairs[firsts] = shapes[firsts] * np.uint64(7)
    three = np.stack([mix(words + np.uint64(1)), mix(shapes + np.uint64(2)), mix(pairs + np.uint64(3))], axis=1)
    return (three.reshape(-1) % np.uint64(BUCKETS)).astype(np.int64), at * 3


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grade, and the text's distinct buckets with their shares."""
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        places, shares = [], []
        for low, high in chunks(bounds):
            buckets, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            for a, b in itertools.pairwise(at):
                own, count = np.unique(buckets[a:b], return_counts=True)
                places.append(own.astype(np.uint32).tobytes())
                shares.append((SCALE * 3 * count / max(b - a, 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(places, pa.binary()), pa.array(shares, pa.binary())],
            names=["grade", "places", "shares"],
        )


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(y > k) for each k, a column each."""
    return sigmoid(np.asarray(score)[:, None] - thresholds[None, :])


def descend(row: np.ndarray, place: np.ndarray, share: np.ndarray, level: np.ndarray, levels: int) -> tuple:
    """Weights and thresholds of largest penalised likelihood, by Adam over all rows."""
    n, k = len(level), levels - 1
    start = np.array([np.mean(level > i) for i in range(k)]).clip(1e-3, 1 - 1e-3)
    cut = -np.log(start / (1 - start))
    # The first threshold, then the logarithms of the steps to the next ones.
    free = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))))
    theta = np.zeros(BUCKETS + k)
    theta[BUCKETS:] = free
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, free = theta[:BUCKETS], theta[BUCKETS:]
        t = np.concatenate((free[:1], free[:1] + np.cumsum(np.exp(free[1:]))))
        score = np.bincount(row, w[place] * share, n)
        upper = np.concatenate((np.ones((n, 1)), tails(score, t), np.zeros((n, 1))), axis=1)
        high, low = upper[np.arange(n), level], upper[np.arange(n), level + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        pull = -(d_high - d_low) / n
        g = np.zeros_like(theta)
        g[:BUCKETS] = np.bincount(place, pull[row] * share, BUCKETS) + PENALTY * w
        by_cut = np.array([(d_high[level == i + 1].sum() - d_low[level == i].sum()) / n for i in range(k)])
        g[BUCKETS] = by_cut.sum()
        for i in range(1, k):
            g[BUCKETS + i] = by_cut[i:].sum() * np.exp(free[i])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (STEPS + 1))
    free = theta[BUCKETS:]
    return theta[:BUCKETS], np.concatenate((free[:1], free[:1] + np.cumsum(np.exp(free[1:]))))


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", limit: int = ROWS) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``ratings(doc_id, <grade>)``.

    Null grades, ids and texts are ignored; of several ratings of a document the least counts.
    """
    rated = ratings.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull())
    rated = rated.groupBy("doc_id").agg(F.min(grade).cast("double").alias("grade"))
    chosen = bounded_sample(rated, "doc_id", limit)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("grade", F.col("text").cast("string"))
    got = rows.mapInArrow(_rated, "grade double, places binary, shares binary").toPandas()
    got = got.sort_values(["grade", "places"]).reset_index(drop=True)
    grades = np.unique(got["grade"].to_numpy())
    if len(grades) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(0), grades if len(grades) else np.zeros(1))
    size = got["places"].str.len().to_numpy() // 4
    weights, thresholds = descend(
        np.repeat(np.arange(len(got)), size),
        np.frombuffer(b"".join(got["places"]), np.uint32).astype(np.int64),
        np.frombuffer(b"".join(got["shares"]), np.float32),
        np.searchsorted(grades, got["grade"].to_numpy()),
        len(grades),
    )
    return Model(weights, thresholds, grades)


def judged(model: Model):
    """A function from a text column to expected grade, tail, and whether there is nothing to rate."""
    weights, thresholds, grades = model.weights, model.thresholds, model.grades

    def judge(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, bounds = utf8(column)
        score, size = np.zeros(len(column)), np.zeros(len(column))
        for low, high in chunks(bounds):
            buckets, at = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            total = np.concatenate(([0.0], np.cumsum(weights[buckets])))
            size[low:high] = np.diff(at)
            score[low:high] = SCALE * 3 * (total[at[1:]] - total[at[:-1]]) / np.maximum(size[low:high], 1)
        beyond = tails(score, thresholds)
        expected = grades[0] + (beyond * np.diff(grades)[None, :]).sum(axis=1)
        tail = beyond[:, -1] if len(thresholds) else np.ones(len(score))
        return expected, tail, size == 0

    return judge


def rate(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``(doc_id, expected_grade, tail, rejected)``, one row per row of ``docs(doc_id, text)``.

    ``tail``: chance of the top grade (1 if the ratings had one grade only). ``rejected``: the
    tail is below ``least_tail``. A null, empty or blank text has nothing to rate: expected
    grade and tail are null, and it is rejected. Other columns are ignored.
    """
    judge = judged(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail, none = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(expected, mask=none), pa.array(tail, mask=none),
                    pa.array(none | (tail < least_tail)),
                ],
                names=["doc_id", "expected_grade", "tail", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail double, rejected boolean")


def select(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs`` without the rejected texts; all columns stay."""
    judge = judged(model)

    def good(column: pa.Array) -> np.ndarray:
        _, tail, none = judge(column)
        return ~none & (tail >= least_tail)

    return keep_rows(docs, good)
