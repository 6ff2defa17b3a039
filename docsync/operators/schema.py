"""Bringing rows to the target's schema: alignment, field removal, stamping, conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPPER_PARSING = "mapper_parsing_exception"
STRICT_DYNAMIC = "strict_dynamic_mapping_exception"


# ---- alignment ---------------------------------------------------------------------------


def _same_shape(have: T.DataType, want: T.DataType) -> bool:
    """Equal types, whatever their nullability."""
    return have.simpleString() == want.simpleString()


def _cast(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """Cast that yields null where a value does not fit, going into structs and arrays by name."""
    if _same_shape(have, want):
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        known = {f.name: f.dataType for f in have.fields}
        parts = [
            (
                _cast(col[f.name], known[f.name], f.dataType)
                if f.name in known
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in want.fields
        ]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(col, lambda v: _cast(v, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return F.transform_values(col, lambda _, v: _cast(v, have.valueType, want.valueType))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) or isinstance(
        want, (T.StructType, T.ArrayType, T.MapType)
    ):
        return F.lit(None).cast(want)
    if isinstance(have, T.StringType) and isinstance(want, T.TimestampType):
        from docsync.functions import parse_date

        return parse_date(col)
    return col.try_cast(want)


def _loses_value(col: Column, have: T.DataType, want: T.DataType) -> Column | None:
    """True where the cast turns a value into null, at any depth; None when it cannot."""
    if _same_shape(have, want):
        return None
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        known = {f.name: f.dataType for f in have.fields}
        checks = [
            _loses_value(col[f.name], known[f.name], f.dataType)
            for f in want.fields
            if f.name in known
        ]
        checks = [c for c in checks if c is not None]
        if not checks:
            return None
        worst = checks[0]
        for check in checks[1:]:
            worst = worst | check
        return col.isNotNull() & F.coalesce(worst, F.lit(False))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):

        def bad(v):
            inner = _loses_value(v, have.elementType, want.elementType)
            return F.lit(False) if inner is None else F.coalesce(inner, F.lit(False))

        return F.coalesce(F.exists(col, bad), F.lit(False))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):

        def bad_value(v):
            inner = _loses_value(v, have.valueType, want.valueType)
            return F.lit(False) if inner is None else F.coalesce(inner, F.lit(False))

        return F.coalesce(F.exists(F.map_values(col), bad_value), F.lit(False))
    return col.isNotNull() & _cast(col, have, want).isNull()


def align(df: DataFrame, schema: T.StructType, extra: str = "drop") -> DataFrame:
    """Columns in the target's order and types; missing ones null, unknown ones dropped.

    ``extra="error"`` refuses unknown columns. Values that do not fit become null; use
    :func:`split_by_schema` to set such rows aside instead.
    """
    if extra not in ("drop", "error"):
        raise ValueError(f"extra must be drop or error, not {extra!r}")
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown and extra == "error":
        raise ValueError(f"columns unknown to the target: {unknown}")
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (
                _cast(F.col(f"`{f.name}`"), have[f.name], f.dataType)
                if f.name in have
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )


def extend(schema: T.StructType, given: T.StructType) -> T.StructType:
    """``schema`` and behind it the columns of ``given`` that it lacks."""
    return T.StructType([*schema.fields, *(f for f in given.fields if f.name not in schema.names)])


def misfit(df: DataFrame, schema: T.StructType, strict: bool = False) -> Column:
    """Why a typed row does not fit the target schema, null when it does."""
    have = {f.name: f.dataType for f in df.schema.fields}
    reason = F.lit(None).cast("string")
    if strict:
        for name in df.columns:
            if name not in schema.names:
                reason = F.when(F.col(f"`{name}`").isNotNull(), STRICT_DYNAMIC).otherwise(reason)
    for field in schema.fields:
        if field.name in have:
            lost = _loses_value(F.col(f"`{field.name}`"), have[field.name], field.dataType)
            if lost is not None:
                reason = F.when(lost, MAPPER_PARSING).otherwise(reason)
    return reason


# ---- field removal -----------------------------------------------------------------------


def parse_paths(paths: str) -> list[list[str]]:
    """``"a, b.c"`` to ``[["a"], ["b", "c"]]``."""
    return [p.strip().split(".") for p in (paths or "").split(",") if p.strip()]


def path_exists(schema: T.DataType, path: Sequence[str]) -> bool:
    """Whether a path leads through structs (or into a map key) to something removable."""
    if isinstance(schema, T.MapType):
        return len(path) == 1 and isinstance(schema.keyType, T.StringType)
    if not isinstance(schema, T.StructType) or path[0] not in schema.names:
        return False
    return len(path) == 1 or path_exists(schema[path[0]].dataType, path[1:])


def _without(col: Column, dtype: T.DataType, path: Sequence[str]) -> tuple[Column, T.DataType]:
    """Column and type after removing an existing nested path."""
    if isinstance(dtype, T.MapType):
        return F.map_filter(col, lambda k, _: k != F.lit(path[0])), dtype
    parts, fields = [], []
    for field in dtype.fields:
        value, kind = col[field.name], field.dataType
        if field.name == path[0]:
            if len(path) == 1:
                continue
            value, kind = _without(value, kind, path[1:])
        parts.append(value.alias(field.name))
        fields.append(T.StructField(field.name, kind))
    if not parts:
        # Spark has no empty struct on file: an emptied object is kept as an empty map.
        empty = F.create_map().cast("map<string,string>")
        return F.when(col.isNotNull(), empty), T.MapType(T.StringType(), T.StringType())
    return F.when(col.isNotNull(), F.struct(*parts)), T.StructType(fields)


def remove_fields(df: DataFrame, paths: str) -> DataFrame:
    """Removes a comma list of dotted paths. Missing paths and arrays on the way are no-ops."""
    for path in parse_paths(paths):
        if not path_exists(df.schema, path):
            continue
        if len(path) == 1:
            df = df.drop(path[0])
        else:
            changed, _ = _without(F.col(f"`{path[0]}`"), df.schema[path[0]].dataType, path[1:])
            df = df.withColumn(path[0], changed)
    return df


def drop_columns(df: DataFrame, cols: Sequence[str] = ("@version", "@timestamp")) -> DataFrame:
    """Drops transport bookkeeping columns; absent ones are ignored."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(cols)])


def stamp(df: DataFrame, column: str, ts) -> DataFrame:
    """Writes one fixed time to every row, so that a repeated batch gives the same rows."""
    value = ts if isinstance(ts, Column) else F.lit(ts)
    return df.withColumn(column, value)
