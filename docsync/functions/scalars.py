"""Column helpers: dates, JSON, ids, strings and portable hashing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RUN_ID_FORMAT = "yyyyMMdd'T'HHmmss'Z'"

# JSON round trips must not lose microseconds (the writer's default stops at milliseconds).
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


# ---- dates ---------------------------------------------------------------------------------


# A year of four digits, then optionally month, day, time, fraction and zone, each in full.
_ISO_DATE = (
    r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])"
    r"([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
)


def parse_date(col: Column) -> Column:
    """ISO-8601 text or epoch milliseconds to a timestamp; null when it is neither.

    Four digits are a year; whole numbers of another length are milliseconds. A date without a
    time is its first moment. Times without a date and one-digit parts are no dates.
    """
    text = F.trim(col.cast("string"))
    padded = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(
        F.length(text) == 7, F.concat(text, F.lit("-01"))
    ).otherwise(text)
    hours = F.regexp_replace(padded, r"([T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    zoned = F.regexp_replace(F.regexp_replace(hours, r"(:\d{2}.*[+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_ISO_DATE), F.try_to_timestamp(F.translate(zoned, ",", "."))).otherwise(
        F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_millis(text.try_cast("bigint")))
    )


def iso(col: Column) -> Column:
    """Timestamp as ``2024-01-31T10:20:30Z`` (the session runs in UTC)."""
    return F.date_format(col, ISO_FORMAT)


def epoch(col: Column) -> Column:
    """Whole seconds since 1970-01-01 UTC."""
    return F.unix_seconds(col.cast("timestamp"))


def minus_seconds(col: Column, seconds: int) -> Column:
    return col - F.make_interval(secs=F.lit(seconds))


def run_id(col: Column) -> Column:
    """Compact UTC run id, ``20240131T102030Z``."""
    return F.date_format(col, RUN_ID_FORMAT)


# ---- JSON ----------------------------------------------------------------------------------

# A quoted string (kept) or a whole number printed with a trailing ".0" (shortened).
_STRING_OR_WHOLE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d+)\.0(?![\dEe])'


def canonical_json(col: Column) -> Column:
    """One text per JSON value: keys sorted at every level, numbers in one notation.

    Array order counts and a null field differs from a missing one. Text that is not JSON is
    returned as it is, so that it still compares with itself.
    """
    text = F.to_json(F.try_parse_json(col))
    # Only numbers written with an exponent come back as doubles ("1e2" as "100.0").
    whole = F.when(
        col.rlike(r"\d[eE]"), F.regexp_replace(text, _STRING_OR_WHOLE, "$1$2")
    ).otherwise(text)
    return F.coalesce(whole, col)


def to_document(columns: Iterable[str | Column], keep_nulls: bool = True) -> Column:
    """JSON text of the given columns, exact to the microsecond."""
    options = {**JSON_TIMES, "ignoreNullFields": "false" if keep_nulls else "true"}
    return F.to_json(F.struct(*columns), options)


def from_document(col: Column, schema: T.StructType) -> Column:
    """Inverse of :func:`to_document`."""
    return F.from_json(col, schema, dict(JSON_TIMES))


def _comparable(col: Column, dtype: T.DataType, reorder: bool) -> Column:
    """Same value with map entries (and, on request, struct fields) in one order.

    Negative zero becomes zero, except inside arrays of objects.
    """
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        pairs = F.map_entries(col)
        if _has_map(dtype.valueType):
            pairs = F.transform(pairs, lambda e: _comparable(e, entry, reorder))
        return F.sort_array(pairs)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, (T.DoubleType, T.FloatType)) or _has_map(inner):
            return F.transform(col, lambda item: _comparable(item, inner, reorder))
        if reorder and _has_struct(inner):
            return F.transform(col, lambda item: _comparable(item, inner, reorder))
        return col
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda field: field.name) if reorder else dtype.fields
        parts = [_comparable(col[f.name], f.dataType, reorder).alias(f.name) for f in fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col + F.lit(0).cast(dtype)
    return col


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, T.MapType)


def _has_struct(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_struct(dtype.elementType)
    return isinstance(dtype, T.StructType)


def fingerprint(
    df: DataFrame, columns: Iterable[str] | None = None, reorder: bool = True
) -> Column:
    """128-bit content hash of the named columns, independent of field and map order.

    Comparing 32 characters instead of whole documents keeps shuffles small. Values are hashed
    under their names and null fields left out, so a null equals a column that is not there,
    which typed rows cannot tell apart anyway, and nulls cannot trade places unnoticed.
    ``reorder=False`` leaves nested fields in their order, which is right for tables of equal
    types and saves rebuilding every array of objects.
    """
    names = sorted(columns if columns is not None else df.columns)
    parts = [_comparable(F.col(f"`{n}`"), df.schema[n].dataType, reorder).alias(n) for n in names]
    if not parts:
        return F.md5(F.lit("{}").cast("binary"))
    return F.md5(to_document(parts, keep_nulls=False).cast("binary"))


# ---- ids and strings -------------------------------------------------------------------------


def clean_id(col: Column) -> Column:
    """Id without a trailing carriage return."""
    return F.regexp_replace(col, r"\r$", "")


def id_suffix(col: Column, separator: str = "-") -> Column:
    """Number after the first separator, -1 when there is none."""
    number = F.split_part(col, F.lit(separator), F.lit(2)).try_cast("bigint")
    return F.coalesce(number, F.lit(-1).cast("bigint"))


def byte_len(col: Column) -> Column:
    return F.octet_length(col)


def collapse_ws(col: Column, width: int | None = None) -> Column:
    """Runs of white space to one blank, trimmed, optionally cut to ``width`` characters."""
    text = F.trim(F.regexp_replace(col, r"\s+", " "))
    return text if width is None else F.substring(text, 1, width)


def zero_pad(col: Column, width: int) -> Column:
    """Digits padded with zeros on the left; longer numbers keep all their digits."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


# ---- portable pseudo-random numbers ------------------------------------------------------------


def hash_text(*parts: Column | str | int) -> Column:
    """md5 over the parts joined by ``|``: the same in every engine and partitioning."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols).cast("binary"))


def hash_int(text: Column, slot: int = 0) -> Column:
    """One of the four unsigned 32-bit integers held by an md5 text."""
    return F.conv(F.substring(text, 1 + 8 * slot, 8), 16, 10).cast("bigint")
