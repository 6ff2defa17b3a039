"""Vectors scaled to whole numbers, and their exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Scaled components beyond this count as this, so that squares stay finite numbers. Scores of
# such vectors are far beyond a long either way.
LARGEST = 1e150
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def usable(vector: Column | str) -> Column:
    """Whether a vector is not null and has neither null nor non-finite components."""
    e = F.col(vector) if isinstance(vector, str) else vector
    e = e.cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return e.isNotNull() & F.coalesce(good, F.lit(False))


def scaled(vector: Column | str) -> Column:
    """floor(256 x) of each component, as double; a whole number, however large.

    ``ceil`` and ``floor`` of Spark return longs, hence the remainder.
    """
    e = F.col(vector) if isinstance(vector, str) else vector

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(e.cast("array<double>"), whole)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as rows; shorter vectors are padded by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), dimension))
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = values
    return out


def smallest(points: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest integers that hold them, or as doubles."""
    most = np.abs(points).max(initial=0)
    return points.astype(next((k for k in (np.int16, np.int32) if most < np.iinfo(k).max), np.float64))


def inner_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as longs; what does not fit is the nearest long.

    Products of doubles are exact below 2**53, sums of longs below 2**63; the few pairs beyond
    that are summed as Python integers.
    """
    if not q.shape[1]:
        return np.zeros((len(q), len(p)), np.int64)
    high_q, high_p = (np.abs(x).max(axis=1, initial=0) for x in (q, p))
    with np.errstate(invalid="ignore", over="ignore"):
        out = q @ p.T
        if q.shape[1] * high_q.max(initial=0) * high_p.max(initial=0) < 2.0**53:
            return out.astype(np.int64)
        most = q.shape[1] * np.outer(high_q, high_p)
        out = np.where(most < 2.0**53, out, 0).astype(np.int64)
    for a in np.flatnonzero((most >= 2.0**53).any(axis=1)).tolist():
        fits = (most[a] >= 2.0**53) & (most[a] < 2.0**62) & (high_p < 2.0**62) & (high_q[a] < 2.0**62)
        if fits.any():
            out[a, fits] = p[fits].astype(np.int64) @ q[a].astype(np.int64)
        rest = np.flatnonzero((most[a] >= 2.0**53) & ~fits)
        own = [int(x) for x in q[a].tolist()] if len(rest) else []
        for b in rest.tolist():
            total = sum(x * int(y) for x, y in zip(own, p[b].tolist(), strict=True))
            out[a, b] = min(max(total, LEAST_LONG), MOST_LONG)
    return out


def width(*tables: DataFrame, column: str = "v") -> int:
    """Length of the longest vector."""
    return max([t.agg(F.max(F.size(column))).first()[0] or 0 for t in tables], default=0)
