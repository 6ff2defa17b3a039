"""What changed, and which ids exist: delta windows, id scans, lookups, key-set pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import clean_id

ID = ("id",)


def delta(df: DataFrame, ts_col: str | None, since=None, op: str = "gt") -> DataFrame:
    """Rows changed after ``since``; all rows when there is no timestamp column.

    ``op="gte"`` restarts inclusively from a stored watermark. Rows without a timestamp never
    match the window. The comparison is a plain literal filter, so it reaches the file scan.
    """
    if ts_col is None:
        return df
    if op not in ("gt", "gte"):
        raise ValueError(f"op must be gt or gte, not {op!r}")
    bound = since if isinstance(since, Column) else F.lit(since)
    column = F.col(ts_col)
    return df.where(column > bound if op == "gt" else column >= bound)


def live_ids(df: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Distinct ids; the payload is never read."""
    return df.select(*keys).distinct()


def union_parts(parts: Sequence[DataFrame], keys: Sequence[str] = ID) -> DataFrame:
    """Ids of several partial scans, each once."""
    merged = parts[0].select(*keys)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*keys))
    return merged.distinct()


def touched(df: DataFrame, ids: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Rows of ``df`` whose id is listed.

    A left join onto the id list cannot broadcast the list. Filtering the large side first can:
    while the list is small (Spark checks its size) the large side is neither shuffled nor
    sorted, and whatever is computed per row afterwards is computed for listed ids only.
    """
    return df.join(ids.select(*keys), list(keys), "left_semi").select(*df.columns)


def lookup(df: DataFrame, ids: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """``keys, found, doc`` for every asked id; ids that do not exist give a row too."""
    wanted = live_ids(ids, keys)
    payload = [c for c in df.columns if c not in keys]
    docs = touched(df, wanted, keys).select(*keys, F.struct(*[F.col(c) for c in payload]).alias("doc"))
    found = wanted.join(docs, list(keys), "left")
    return found.select(*keys, F.col("doc").isNotNull().alias("found"), "doc")


def label_changes(changes: DataFrame, target: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Adds ``kind``: ``update`` when the target holds the id already, else ``create``."""
    known = live_ids(touched(target.select(*keys), changes, keys), keys)
    known = known.withColumn("_known", F.lit(True))
    return (
        changes.join(known, list(keys), "left")
        .withColumn("kind", F.when(F.col("_known"), "update").otherwise("create"))
        .drop("_known")
    )


def page(
    df: DataFrame,
    ts_col: str,
    after: tuple | None,
    size: int,
    op: str = "gt",
    since=None,
    key: str = "id",
) -> DataFrame:
    """One preview page in (timestamp, id) order, continuing behind the pair ``after``.

    A page is a top-k: each task keeps ``size`` rows. Runs process the whole window instead.
    """
    rows = delta(df, ts_col, since, op) if since is not None else df
    if after is not None:
        last_ts, last_id = (v if isinstance(v, Column) else F.lit(v) for v in after)
        rows = rows.where(
            (F.col(ts_col) >= last_ts)
            & ((F.col(ts_col) > last_ts) | (F.col(key) > last_id))
        )
    return rows.orderBy(ts_col, key).limit(size)


def clean_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Id list without carriage returns and empty lines."""
    return df.select(clean_id(F.col(column)).alias(column)).where(F.length(column) > 0)


def sorted_ids(df: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Distinct ids in byte order: a range-partitioned, spilling sort."""
    return live_ids(df, keys).orderBy(*keys)
