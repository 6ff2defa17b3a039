"""Writing a change set into a table: upsert, merge, delete, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import fingerprint
from docsync.operators.extract import ID, live_ids, touched


def apply_upserts(
    target: DataFrame, changes: DataFrame, keys: Sequence[str] = ID
) -> DataFrame:
    """Whole-row replace or insert by id. ``changes`` holds each id once (see ``latest``)."""
    kept = target.join(live_ids(changes, keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(changes.select(*target.columns))


def apply_deletes(target: DataFrame, ids: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Rows whose id is not listed; deleting an absent id is a success."""
    kept = target.join(live_ids(ids, keys), list(keys), "left_anti")
    return kept.select(*target.columns)


def latest(changes: DataFrame, order: str | Column, keys: Sequence[str] = ID) -> DataFrame:
    """Newest row per id. Copies of one id collapse inside each task before the shuffle.

    Of rows that are equally new the one of the largest content hash stays, whatever their order.
    """
    payload = F.struct(*[F.col(c) for c in changes.columns])
    order = F.col(order) if isinstance(order, str) else order
    content = fingerprint(changes, [c for c in changes.columns if c not in keys])
    newest = changes.groupBy(*keys).agg(F.max_by(payload, F.struct(order, content)).alias("_row"))
    return newest.select("_row.*")


def _merge(old: Column, new: Column, dtype: T.DataType, old_type: T.DataType) -> Column:
    """Object fields merge child by child, anything else is replaced by the given value."""
    if isinstance(dtype, T.StructType) and isinstance(old_type, T.StructType):
        given = {f.name: f.dataType for f in dtype.fields}
        parts = []
        for field in old_type.fields:
            before = old[field.name]
            if field.name not in given:
                parts.append(before.alias(field.name))
                continue
            value = _merge(before, new[field.name], given[field.name], field.dataType)
            parts.append(value.alias(field.name))
        return F.when(new.isNull() & old.isNull(), None).otherwise(F.struct(*parts))
    if isinstance(dtype, T.MapType) and isinstance(old_type, T.MapType):
        kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
        merged = F.map_concat(kept, new)
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(merged)
    return F.coalesce(new, old)


def apply_merge(
    target: DataFrame,
    patch: DataFrame,
    set_fields: str | None = None,
    keys: Sequence[str] = ID,
) -> DataFrame:
    """Partial update: fields the patch does not set keep their old value; new ids insert.

    A patch field counts as set when it is not null. ``set_fields`` names an array column of
    the patch that lists the set fields instead, which also allows setting a field to null.
    """
    payload = [c for c in target.columns if c not in keys]
    given = [c for c in payload if c in patch.columns]
    extras = [set_fields] if set_fields else []
    new = patch.select(
        *keys,
        F.struct(*[F.col(c) for c in given + extras], F.lit(True).alias("_given")).alias("_new"),
    )
    old = target.select(*keys, F.struct(*[F.col(c) for c in payload]).alias("_old"))
    # Left join plus inserts instead of a full outer join: a small patch is then broadcast and
    # the target stays where it is.
    known = target.select(*keys).join(patch.select(*keys), list(keys), "left_semi")
    inserts = new.join(known, list(keys), "left_anti").withColumn(
        "_old", F.lit(None).cast(old.schema["_old"].dataType)
    )
    joined = old.join(new, list(keys), "left").unionByName(inserts)
    columns = [F.col(k) for k in keys]
    for name in payload:
        before = F.col("_old")[name]
        if name not in given:
            columns.append(before.alias(name))
            continue
        after = F.col("_new")[name]
        merged = _merge(before, after, patch.schema[name].dataType, target.schema[name].dataType)
        if set_fields:
            is_set = F.array_contains(F.col("_new")[set_fields], name)
            merged = F.when(is_set & after.isNull(), None).when(is_set, merged).otherwise(before)
        columns.append(merged.alias(name))
    return joined.select(*columns).select(*target.columns)


def repair_rows(src: DataFrame, ids: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Source rows for the ids the target lacks; ids the source lost meanwhile give no row."""
    return touched(src, ids, keys)
