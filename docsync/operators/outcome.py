"""Write outcomes: pairing, classification, dead letters, rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import canonical_json, collapse_ws
from docsync.functions.types import struct_of
from docsync.operators.extract import touched
from docsync.operators.schema import MAPPER_PARSING, STRICT_DYNAMIC

# Transient status codes and error types of the write protocol.
RETRY_STATUS = (429, 502, 503, 504)
RETRY_ERRORS = ("es_rejected_execution", "circuit_breaking", "cluster_block", "unavailable_shards")


def explode_results(results: DataFrame) -> DataFrame:
    """``batch, items`` to one row per item with its position as ``ordinal``."""
    item = F.map_entries("item")[0]
    return results.select("batch", F.posexplode("items").alias("ordinal", "item")).select(
        "batch",
        "ordinal",
        item["key"].alias("op"),
        item["value"]["_id"].alias("_id"),
        item["value"]["status"].alias("status"),
        item["value"]["error"].alias("error"),
    )


def pair(results: DataFrame, submitted: DataFrame) -> DataFrame:
    """Result item *n* of a batch with submitted row *n*; items beyond it pair with nothing."""
    return results.join(submitted, ["batch", "ordinal"], "left")


def verdict(op: Column, status: Column, error_type: Column) -> Column:
    """ok, retry or fatal. A missing status counts as 200, deleting an absent row as success."""
    status = F.coalesce(status, F.lit(200))
    transient = status.isin(*RETRY_STATUS) | F.coalesce(error_type, F.lit("")).rlike(
        "|".join(RETRY_ERRORS)
    )
    return (
        F.when((status < 300) | ((op == "delete") & (status == 404)), "ok")
        .when(transient, "retry")
        .otherwise("fatal")
    )


def classify(df: DataFrame, final: bool = False) -> DataFrame:
    """Adds ``verdict``; on the last attempt a transient failure becomes ``exhausted``."""
    kind = verdict(F.col("op"), F.col("status"), F.col("error.type"))
    if final:
        kind = F.when(kind == "retry", "exhausted").otherwise(kind)
    return df.withColumn("verdict", kind)


def tally(df: DataFrame) -> DataFrame:
    """One row: ``ok, retry, fatal, exhausted``."""
    return df.agg(
        *[
            F.count_if(F.col("verdict") == name).alias(name)
            for name in ("ok", "retry", "fatal", "exhausted")
        ]
    )


def dead_letters(df: DataFrame, tag: str) -> DataFrame:
    """Records of classified rows that will not be tried again."""
    dead = df.where(F.col("verdict").isin("fatal", "exhausted"))
    return dead.select(
        F.coalesce("_id", F.lit("")).alias("_id"),
        F.lit(tag).alias("tag"),
        F.coalesce("status", F.lit(200)).alias("status"),
        "error",
        (F.col("verdict") == "exhausted").alias("retry_exhausted"),
        "action",
        "source",
    )


DEAD_LETTER = struct_of(
    _id="string",
    tag="string",
    status="int",
    error=struct_of(type="string", reason="string"),
    retry_exhausted="boolean",
    action="string",
    source="string",
)


def rejected(df: DataFrame, tag: str, key: str = "id") -> DataFrame:
    """Dead letters of rows a schema check refused; ``df`` has ``reject`` and ``source``."""
    return df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"),
        F.lit(tag).alias("tag"),
        F.lit(400).alias("status"),
        F.struct(
            F.col("reject").alias("type"),
            F.lit("row does not fit the target schema").alias("reason"),
        ).alias("error"),
        F.lit(False).alias("retry_exhausted"),
        F.lit("index").alias("action"),
        F.col("source"),
    )


def parse_dead_letters(lines: DataFrame, column: str = "value") -> DataFrame:
    """Dead letters from JSON lines; lines that are not JSON objects are skipped."""
    schema = T.StructType(DEAD_LETTER.fields + [T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.from_json(column, schema, options).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select(
        *[F.col("r")[f.name].alias(f.name) for f in DEAD_LETTER.fields]
    )


def summarise(dead: DataFrame, k: int = 5, order: str | None = None) -> DataFrame:
    """Most frequent ``tag, status, type`` with count ``n`` and the first reason.

    ``order`` says which reason is first; without it the smallest text stands for the group.
    """
    reason = collapse_ws(F.coalesce("error.reason", F.lit("")), 120)
    first = F.min_by(reason, order) if order else F.min(reason)
    groups = dead.groupBy(
        F.coalesce(F.when(F.col("tag") != "", F.col("tag")), F.lit("?")).alias("tag"),
        F.coalesce(F.col("status").cast("string"), F.lit("?")).alias("status"),
        F.coalesce("error.type", F.lit("-")).alias("type"),
    ).agg(F.count(F.lit(1)).alias("n"), first.alias("reason"))
    return groups.orderBy(F.desc("n"), "tag", "status", "type").limit(k)


def conform(
    df: DataFrame, json_col: str, schema: T.StructType, strict: bool = False, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Splits JSON documents into typed rows and dead letters.

    A value of the wrong type or text that is not JSON is ``mapper_parsing_exception``; a
    field the schema does not know is ``strict_dynamic_mapping_exception`` under ``strict``.
    """
    checked = _check_json(df, json_col, schema, strict)
    others = [c for c in df.columns if c != json_col and c not in schema.names]
    ok = checked.where("reject is null").select(
        *others, *[F.col("_doc")[f.name].alias(f.name) for f in schema.fields]
    )
    dead = rejected(checked.where("reject is not null").withColumn("source", F.col(json_col)), "delta", key)
    return ok, dead


def _check_json(df: DataFrame, json_col: str, schema: T.StructType, strict: bool) -> DataFrame:
    marked = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    doc = F.from_json(json_col, marked, options)
    bad = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    reject = F.when(bad, MAPPER_PARSING)
    if strict:
        reject = reject.when(_has_unknown_keys(F.col(json_col), schema), STRICT_DYNAMIC)
    return df.withColumn("_doc", doc).withColumn("reject", reject)


def _has_unknown_keys(text: Column, schema: T.StructType) -> Column:
    """True where the object, or an object nested in it, has a key the schema lacks."""
    known = F.array(*[F.lit(n) for n in schema.names])
    found = F.size(F.array_except(F.json_object_keys(text), known)) > 0
    for field in schema.fields:
        inner = field.dataType
        part = F.get_json_object(text, f"$['{field.name}']")
        if isinstance(inner, T.StructType):
            found = found | F.coalesce(_has_unknown_keys(part, inner), F.lit(False))
        elif isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
            items = F.from_json(part, "array<string>")
            nested = F.exists(items, _unknown_key_test(inner.elementType))
            found = found | F.coalesce(nested, F.lit(False))
    return found


def _unknown_key_test(schema: T.StructType):
    return lambda item: F.coalesce(_has_unknown_keys(item, schema), F.lit(False))


def reconform(
    dead: DataFrame, schema: T.StructType, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Tries dead-lettered documents again, after the target schema was corrected."""
    return conform(dead.select(F.col("_id").alias("id"), "source"), "source", schema, strict)


def unresolved(dead: DataFrame, src: DataFrame, tgt: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``id, state`` per dead-lettered id: absent, stale or recovered on the target.

    ``doc_col`` holds the JSON document; an id that left the source is ``gone`` when the target
    lacks it too, and ``stale`` when the target still has it.
    """
    ids = dead.select(F.col("_id").alias("id")).distinct()

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(F.col("id").cast("string").alias("id"), F.col(doc_col).alias("_doc"))
        return touched(keyed, ids).select("id", canonical_json(F.col("_doc")).alias(name))

    joined = ids.join(side(src, "s"), "id", "left").join(side(tgt, "t"), "id", "left")
    return joined.select(
        "id",
        F.when(F.col("s").isNull() & F.col("t").isNull(), "gone")
        .when(F.col("t").isNull(), "absent")
        .when(F.col("s").eqNullSafe(F.col("t")), "recovered")
        .otherwise("stale")
        .alias("state"),
    )
