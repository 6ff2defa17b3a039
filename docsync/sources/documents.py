"""Typed reading of JSON documents by a declared field mapping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions.types import struct_of
from docsync.operators.schema import align, misfit

# Declared field types and the Spark types they are read as.
FIELD_TYPES = {
    "keyword": T.StringType(),
    "text": T.StringType(),
    "ip": T.StringType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "long": T.LongType(),
    "integer": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
    "geo_point": struct_of(lat="double", lon="double"),
}


def properties(mapping: dict) -> dict:
    """Field declarations of a mapping, with or without a type name around them."""
    body = mapping.get("mappings", mapping)
    if "properties" not in body and len(body) == 1:
        body = next(iter(body.values()))
    return body.get("properties", body)


def mapping_schema(mapping: dict, arrays: Iterable[str] = ()) -> T.StructType:
    """Declared fields to a ``StructType``.

    A mapping does not say which plain fields hold several values; ``arrays`` lists their
    dotted paths.
    """
    many = set(arrays)

    def field_type(spec: dict, path: str) -> T.DataType:
        if "properties" in spec:
            inner = fields(spec["properties"], path + ".")
            return T.ArrayType(inner) if spec.get("type") == "nested" else inner
        if spec.get("type") in ("object", "nested"):
            return T.MapType(T.StringType(), T.StringType())
        dtype = FIELD_TYPES[spec["type"]]
        return T.ArrayType(dtype) if path in many else dtype

    def fields(props: dict, prefix: str = "") -> T.StructType:
        return T.StructType(
            [T.StructField(n, field_type(spec, prefix + n)) for n, spec in props.items()]
        )

    return fields(properties(mapping))


def _raw(dtype: T.DataType) -> T.DataType:
    """The type a field is parsed as: dates stay text, since they may be epoch numbers."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _raw(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_raw(dtype.elementType))
    return T.StringType() if isinstance(dtype, T.TimestampType) else dtype


def parse_documents(
    lines: DataFrame, schema: T.StructType, column: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """JSON text to typed rows; second, the lines that do not fit as ``value, reject``."""
    raw = _raw(schema)
    marked = T.StructType([*raw.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    doc = F.from_json(column, marked, options)
    flat = lines.select(F.col(column).alias("_line"), doc.alias("_doc")).select(
        "_line", "_doc._bad", *[F.col("_doc")[n].alias(n) for n in schema.names]
    )
    broken = F.col("_bad").isNotNull()
    typed = flat.select(*schema.names)
    reject = F.when(broken, "mapper_parsing_exception").otherwise(misfit(typed, schema))
    flat = flat.withColumn("_reject", reject)
    good = align(flat.where("_reject is null"), schema)
    bad = flat.where("_reject is not null").select(
        F.col("_line").alias("value"), F.col("_reject").alias("reject")
    )
    return good, bad


def read_documents(
    spark: SparkSession, path: str, mapping: dict, arrays: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """One JSON document per line, typed by the mapping, and the lines that do not fit."""
    return parse_documents(spark.read.text(path), mapping_schema(mapping, arrays))


def with_subfields(df: DataFrame, mapping: dict) -> DataFrame:
    """Adds ``<field>_<sub>`` for declared keyword subfields, null above ``ignore_above``."""
    for name, spec in properties(mapping).items():
        for sub, inner in spec.get("fields", {}).items():
            limit = inner.get("ignore_above")
            value = F.col(name)
            if limit is not None:
                value = F.when(F.length(name) <= limit, value)
            df = df.withColumn(f"{name}_{sub}", value)
    return df


def is_ip(col: Column) -> Column:
    """Whether text is an IPv4 address."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return col.rlike(rf"^{octet}(\.{octet}){{3}}$")
