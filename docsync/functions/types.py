"""Schemas stated without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def struct_of(**fields: str | T.DataType) -> T.StructType:
    """``struct_of(id="string", n="bigint")``."""
    return T.StructType(
        [T.StructField(n, SIMPLE[t] if isinstance(t, str) else t) for n, t in fields.items()]
    )
