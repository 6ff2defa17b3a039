"""Language identification by nearest centroid of character n-grams.

A text is a vector of TF-IDF weights of its letter n-grams (one to three letters, word ends
included) in a fixed number of hashed dimensions, scaled to length one. Each language has
several centroids, found by spherical k-means over its own training texts. The language of the
centroid of largest cosine wins. A text farther from it than that centroid's own training texts
reach (with some slack, and more for short texts) is rejected.

Fitted on at most ``ROWS_PER_LANGUAGE`` texts per language; every text is scored whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.sample import bounded_sample, keep_rows

DIMENSIONS = 4096
ORDERS = 3
CENTROIDS = 4
ROWS_PER_LANGUAGE = 1000
ROUNDS = 8
# Reach of a centroid: this quantile of its members' cosines, times the slack.
REACH_QUANTILE, REACH_SLACK = 0.01, 0.5
# Cosines of short texts are low by nature; the reach shrinks below about so many letters.
SHORT = 200
PIECE = 1 << 18
UNKNOWN = "und"


@functools.cache
def letter_table() -> np.ndarray:
    """True for letters, by code point; made once per process."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def count_ngrams(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Counts per hashed dimension; None for a text without letters. Long texts go in pieces."""
    total = np.zeros(DIMENSIONS, np.int64)
    seen = False
    for start in range(0, len(text), PIECE):
        # Pieces overlap by the n-gram length, so that no n-gram is lost or counted twice.
        piece = text[max(start - ORDERS + 1, 0) : start + PIECE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters[code]
        seen = seen or bool(is_letter.any())
        code = np.where(is_letter, code, 32)
        edge = np.full(1, 32, np.uint32)
        code = np.concatenate((edge[: start == 0], code, edge[: start + PIECE >= len(text)])).astype(np.uint32)
        gram = np.zeros(len(code), np.uint32)
        for n in range(1, ORDERS + 1):
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
            place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
            fresh = slice(ORDERS - n if start else 0, None)
            place = place[fresh][code[fresh] != 32] if n == 1 else place[fresh]
            total += np.bincount(place, minlength=DIMENSIONS)
    return total if seen else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    reach: np.ndarray


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, and the text's dimensions that are not zero with their counts."""
    letters = letter_table()
    for batch in batches:
        langs, places, out = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = count_ngrams(text.as_py() or "", letters)
            if counts is not None:
                own = np.flatnonzero(counts)
                langs.append(lang)
                places.append(own.astype(np.uint16).tobytes())
                out.append(counts[own].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(out, pa.binary())],
            names=["lang", "places", "counts"],
        )


def _dense(places: list[bytes], counts: list[bytes]) -> np.ndarray:
    """Count rows, sorted, so that they do not depend on the order in which they came."""
    rows = np.zeros((len(places), DIMENSIONS), np.uint32)
    for row, place, count in zip(rows, places, counts, strict=True):
        row[np.frombuffer(place, np.uint16)] = np.frombuffer(count, np.uint32)
    return rows[sorted(range(len(rows)), key=lambda i: rows[i].tobytes())]


def k_means(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread-out starting rows; at most ``k`` centroids."""
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, rows @ rows[far])
    centroids = rows[chosen]
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.array([rows[own == c].sum(axis=0) for c in range(len(centroids)) if (own == c).any()])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def fit(rows: DataFrame, limit: int = ROWS_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fit on ``rows(doc_id, text, lang)``; null languages and texts without letters are ignored."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(known, "doc_id", limit, by="lang").select(F.col("lang").cast("string"), "text")
    got = sample.mapInArrow(_counts, "lang string, places binary, counts binary").toPandas()
    if got.empty:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((1, DIMENSIONS), np.float32), [UNKNOWN], np.ones(1))
    held = np.zeros(DIMENSIONS, np.int64)
    for place in got["places"]:
        held[np.frombuffer(place, np.uint16)] += 1
    idf = np.log((1 + len(got)) / (1 + held)).astype(np.float32) + np.float32(0.1)
    all_centroids, languages, reach = [], [], []
    # Rows are whole for one language at a time.
    for lang in sorted(set(got["lang"])):
        mine = got[got["lang"] == lang]
        own = weigh(_dense(list(mine["places"]), list(mine["counts"])), idf)
        found = k_means(own, centroids)
        cosine = own @ found.T
        nearest = cosine.argmax(axis=1)
        for c in range(len(found)):
            members = cosine[nearest == c, c]
            reach.append(REACH_SLACK * np.quantile(members, REACH_QUANTILE) if len(members) else 1.0)
        all_centroids.append(found)
        languages += [lang] * len(found)
    return Model(idf, np.concatenate(all_centroids), languages, np.array(reach))


def judged(model: Model):
    """A function from a text column to predicted languages, cosines and rejections."""
    idf, centroids, languages, reach = model.idf, model.centroids, model.languages, model.reach

    def judge(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = letter_table()
        best, score, least = np.full(len(column), -1), np.zeros(len(column)), np.ones(len(column))
        for low in range(0, len(column), 100):
            counts = [count_ngrams(t.as_py() or "", letters) for t in column.slice(low, 100)]
            rows = [i for i, c in enumerate(counts) if c is not None]
            if rows:
                own = np.array([counts[i] for i in rows])
                cosine = weigh(own, idf) @ centroids.T
                at = low + np.array(rows)
                best[at] = cosine.argmax(axis=1)
                score[at] = np.clip(cosine.max(axis=1), 0, 1)
                size = own.sum(axis=1) / ORDERS
                least[at] = reach[best[at]] * np.sqrt(size / (size + SHORT))
        return [languages[b] if b >= 0 else UNKNOWN for b in best], score, (best < 0) | (score < least)

    return judge


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``, one row per row of ``docs(doc_id, text)``.

    ``lang_pred`` is ``und`` for null texts and texts without a letter, with score 0. ``score``
    is the cosine, clipped to 0 to 1. ``rejected``: ``und``, or out of the centroid's reach.
    Equal cosines go to the first language by name. Other columns are ignored.
    """
    judge = judged(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def select(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rejected texts; all columns stay."""
    judge = judged(model)
    return keep_rows(docs, lambda column: ~judge(column)[2])


def held_out() -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    return predict(docs, fit(docs.where(~held_out()))).withColumn("held_out", held_out())
