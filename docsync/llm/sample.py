"""Bounded samples for fitting classifiers, and row filters for applying them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the row's own values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, key: str, limit: int, by: str | None = None) -> DataFrame:
    """About ``limit`` rows at most (per value of ``by``), chosen by the hash of ``key``.

    One grouped count fixes the fraction. The same rows are chosen whatever the partitions.
    """
    if by is None:
        count = rows.count()
        return rows if count <= limit else rows.where(unit(key, F.lit("fit")) < limit / count)
    counts = rows.groupBy(by).count().collect()
    keep = F.lit(False)
    for row in counts:
        share = unit(key, F.lit("fit")) < limit / row["count"]
        keep = keep | ((F.col(by) == row[by]) & (share if row["count"] > limit else F.lit(True)))
    return rows.where(keep)


def keep_rows(docs: DataFrame, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose text column passes ``good``; columns pass by position, untouched."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(good(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
