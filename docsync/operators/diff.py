"""Comparing two keyed tables.

Both sides are reduced to ids (or id and content hash) and brought together by one grouped
aggregate over their union. Compared with a full outer join this needs no sort, and an id that
is repeated many times collapses before the shuffle instead of multiplying.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import fingerprint
from docsync.operators.extract import ID, live_ids
from docsync.operators.schema import remove_fields


def presence(src: DataFrame, tgt: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """``keys, n_src, n_tgt``: how many rows each side holds per id (null ids included)."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = src.select(*keys, one.alias("s"), zero.alias("t")).unionByName(
        tgt.select(*keys, zero.alias("s"), one.alias("t"))
    )
    return both.groupBy(*keys).agg(F.sum("s").alias("n_src"), F.sum("t").alias("n_tgt"))


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Ids of ``a`` that ``b`` lacks."""
    return live_ids(a, keys).join(live_ids(b, keys), list(keys), "left_anti")


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """The same as a set operation, where null equals null."""
    return a.select(*keys).subtract(b.select(*keys))


def diff(
    src: DataFrame,
    tgt: DataFrame,
    compare: Sequence[str] | None = None,
    keys: Sequence[str] = ID,
) -> DataFrame:
    """``keys, status`` with status only_source, only_target, same or changed.

    Only id and two 64-bit halves of a content hash are shuffled; numbers keep the aggregate a
    hash aggregate, where text would be sorted. A column that one side lacks compares as null.
    An id repeated on a side is the same only when all copies agree.
    """
    shared = [c for c in src.columns if c in tgt.columns]
    differing = any(
        src.schema[c].dataType.simpleString() != tgt.schema[c].dataType.simpleString() for c in shared
    )
    hashed = []
    for df in (src, tgt):
        payload = [c for c in df.columns if c not in keys and (compare is None or c in compare)]
        content = df.select(*keys, fingerprint(df, payload, reorder=differing).alias("h"))
        h1, h2 = halves(F.col("h"))
        hashed.append(content.select(*keys, h1.alias("h1"), h2.alias("h2")))
    return statuses(*hashed, keys)


def halves(content: Column) -> tuple[Column, Column]:
    """Two 60-bit integers of a content hash."""
    return tuple(F.conv(F.substring(content, start, 15), 16, 10).cast("bigint") for start in (1, 16))


def statuses(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str] = ID, counted: bool = False
) -> DataFrame:
    """``keys, status`` from ``keys, h1, h2`` of both sides, in one grouped aggregate.

    With ``counted`` an id is the same only when both sides hold equally many rows of it.
    """
    tagged = [df.select(*keys, F.lit(tag).alias("side"), "h1", "h2") for tag, df in (("s", src), ("t", tgt))]
    in_src = F.max(F.col("side") == "s")
    in_tgt = F.max(F.col("side") == "t")
    equal = (F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))
    if counted:
        equal = equal & (F.count_if(F.col("side") == "s") == F.count_if(F.col("side") == "t"))
    return (
        tagged[0]
        .unionByName(tagged[1])
        .groupBy(*keys)
        .agg(in_src.alias("s"), in_tgt.alias("t"), equal.alias("eq"))
        .select(
            *keys,
            F.when(~F.col("t"), "only_source")
            .when(~F.col("s"), "only_target")
            .when(F.col("eq"), "same")
            .otherwise("changed")
            .alias("status"),
        )
    )


def content_diff(
    src: DataFrame,
    tgt: DataFrame,
    removed: str = "",
    keys: Sequence[str] = ID,
) -> DataFrame:
    """Ids of the source whose target row is absent or different.

    ``removed`` is stripped from the source only: a target row that still holds a value in such
    a field counts as different.
    """
    status = diff(remove_fields(src, removed), tgt, None, keys)
    return status.where(F.col("status").isin("only_source", "changed")).select(*keys)


def expected_ids(
    tgt: DataFrame, to_delete: DataFrame, to_repair: DataFrame, keys: Sequence[str] = ID
) -> DataFrame:
    """``(target - to_delete) + to_repair`` as a set of ids."""
    kept = only_in(tgt, to_delete, keys)
    return kept.unionByName(to_repair.select(*keys)).distinct()


def set_mismatch(actual: DataFrame, wanted: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """``keys, side``: extra ids of ``actual`` and ids missing from it; empty when equal."""
    counts = presence(actual, wanted, keys)
    return counts.where((F.col("n_src") == 0) | (F.col("n_tgt") == 0)).select(
        *keys, F.when(F.col("n_tgt") == 0, "extra").otherwise("missing").alias("side")
    )
