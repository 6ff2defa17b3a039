"""Digests of stored versions, and comparing versions by them.

Three levels lie beside a versioned table, each made from the one below:

* **Prints**: for every base and change set, id and content hash of its rows, in the same buckets.
  A folder of rows never changes, so its prints are made once, whatever versions use it.
* **Ranges**: for a version, an order-free sum of the prints for each sub-range of each bucket.
* **Total**: the sum over all ranges, in the version's digest record.

Versions with equal totals are equal, for which two small files are read. Otherwise the ranges
are compared, and then the prints of the files that hold differing ranges. Documents are read only to
make prints of folders that have none yet.

Sums can be added: tables of different numbers of buckets are compared in the buckets of the
greatest common divisor of both. They hold hashes of id and content together, so that rows cannot trade
contents unnoticed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import fingerprint
from docsync.functions.types import struct_of
from docsync.operators.diff import halves, statuses
from docsync.sources import files, store

# Sub-ranges of a bucket.
PARTS = 64
SUMS = ["n", "s1", "s2", "s3", "s4"]
RANGES = struct_of(bucket="int", part="int", **dict.fromkeys(SUMS, "bigint"))


class NotComparable(ValueError):
    """Columns of one name have different types, so that their hashes differ for equal values."""


# ---- prints ------------------------------------------------------------------------------


def _print_schema(commit: dict, layer: bool) -> T.StructType:
    op = [T.StructField(store.OP, T.StringType())] if layer else []
    hashes = [T.StructField(h, T.LongType()) for h in ("h1", "h2")]
    return T.StructType([store.schema_of(commit)["id"], *op, *hashes])


def _hashed(commit: dict, held: Sequence[str]) -> dict[str, str]:
    """Columns that a folder's files hold and the version has: others are null and not hashed."""
    return {f.name: f.dataType.simpleString() for f in store.schema_of(commit).fields if f.name in held}


def _made(spark: SparkSession, root: str, name: str, commit: dict) -> str | None:
    """Folder of the prints of a base or change set, if they were made of the same columns."""
    home = f"{root}/_prints/{name}"
    for record in files.names(spark, home):
        known = files.read_json(spark, f"{home}/{record}") if record.endswith(".json") else None
        if known and known["hashed"] == _hashed(commit, known["held"]):
            return f"{home}/{known['folder']}"
    return None


def _prints_of(spark: SparkSession, root: str, name: str, commit: dict, layer: bool) -> DataFrame:
    """Prints of one base or change set, made if there are none."""
    path = _made(spark, root, name, commit)
    if path is None:
        schema = store.schema_of(commit)
        read = store.layer_schema(schema) if layer else schema
        rows = store.read_bucketed(spark, f"{root}/{name}", read, commit["buckets"])
        h1, h2 = halves(fingerprint(rows, schema.names))
        folder = uuid.uuid4().hex
        path = f"{root}/_prints/{name}/{folder}"
        wanted = _print_schema(commit, layer)
        store.write_bucketed(rows.withColumns({"h1": h1, "h2": h2}).select(*wanted.names), path, commit["buckets"])
        written = any(n.endswith(".parquet") for n in files.names(spark, f"{root}/{name}"))
        held = spark.read.parquet(f"{root}/{name}").columns if written else []
        # Visible when whole; of two makers at once either one's will do.
        files.create_json(spark, f"{path}.json", {"folder": folder, "held": held, "hashed": _hashed(commit, held)})
    return store.read_bucketed(spark, path, _print_schema(commit, layer), commit["buckets"])


def prints(
    spark: SparkSession, root: str, version: int | None = None, buckets: Sequence[int] | None = None
) -> DataFrame:
    """``id, h1, h2``: id and two 60-bit halves of the content hash of a version's rows.

    ``buckets`` opens the files of these buckets only.
    """
    commit = store.read_commit(spark, root, version)

    def some(rows: DataFrame) -> DataFrame:
        if buckets is None:
            return rows
        # A condition on the file's name is decided before files are opened.
        number = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.c\d+", 1).cast("int")
        return rows.where(number.isin(list(buckets))).select(*rows.columns)

    rows = some(_prints_of(spark, root, commit["base"], commit, False))
    for name in commit["layers"]:
        rows = store.overlay(rows, some(_prints_of(spark, root, name, commit, True)))
    return rows


# ---- digests -----------------------------------------------------------------------------


def _range_columns(buckets: int) -> dict:
    """Bucket as Spark deals it, and a sub-range that doesn't depend on the number of buckets."""
    return {
        "bucket": F.pmod(F.hash("id"), F.lit(buckets)),
        "part": F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"),
    }


def _sums(rows: DataFrame, buckets: int) -> DataFrame:
    """``bucket, part, n, s1, .., s4``: rows and sums of 30-bit words, exact for 2**33 rows a range."""
    words = [F.shiftright(h, s).bitwiseAND(F.lit((1 << 30) - 1)) for h in ("h1", "h2") for s in (30, 0)]
    sums = [F.sum(w).alias(name) for name, w in zip(SUMS[1:], words, strict=True)]
    return rows.withColumns(_range_columns(buckets)).groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), *sums)


def _digest_home(root: str, version: int) -> str:
    return f"{root}/_digests/{version:010d}"


def kept(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """Digest record of a version, None when it was not made."""
    version = version or store.current_version(spark, root)
    path = f"{_digest_home(root, version)}/record.json"
    return files.read_json(spark, path) if files.exists(spark, path) else None


def keep(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Makes the digest of a version, unless it is there; returns its record.

    After a change set only that change set's documents are hashed; the prints of the others are there.
    """
    commit = store.read_commit(spark, root, version)
    known = kept(spark, root, commit["version"])
    if known:
        return known
    home, folder = _digest_home(root, commit["version"]), uuid.uuid4().hex
    _sums(prints(spark, root, commit["version"]), commit["buckets"]).write.parquet(f"{home}/{folder}")
    ranges = spark.read.schema(RANGES).parquet(f"{home}/{folder}")
    # The sum over all ranges may pass a long.
    total = ranges.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in SUMS]).first()
    record = {
        "version": commit["version"],
        "buckets": commit["buckets"],
        "folder": folder,
        "total": {c: str(total[c] or 0) for c in SUMS},
    }
    if files.create_json(spark, f"{home}/record.json", record):
        return record
    return kept(spark, root, commit["version"])


def ranges_of(spark: SparkSession, root: str, version: int | None = None, buckets: int | None = None) -> DataFrame:
    """``bucket, part, n, s1, .., s4`` of a version; ``buckets`` is a divisor of the table's number."""
    record = keep(spark, root, version)
    rows = spark.read.schema(RANGES).parquet(f"{_digest_home(root, record['version'])}/{record['folder']}")
    buckets = buckets or record["buckets"]
    if record["buckets"] % buckets:
        raise ValueError(f"{buckets} does not divide {record['buckets']} buckets")
    if buckets == record["buckets"]:
        return rows
    rolled = rows.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    return rolled.groupBy("bucket", "part").agg(*[F.sum(c).alias(c) for c in SUMS])


# ---- comparing ---------------------------------------------------------------------------


def mismatched(a: T.StructType, b: T.StructType) -> list[str]:
    """Columns that both have, in types whose hashes differ; field order doesn't matter."""

    def shape(kind: T.DataType):
        if isinstance(kind, T.StructType):
            return sorted((f.name, shape(f.dataType)) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return ["array", shape(kind.elementType)]
        if isinstance(kind, T.MapType):
            return ["map", shape(kind.keyType), shape(kind.valueType)]
        return kind.simpleString()

    return sorted(n for n in set(a.names) & set(b.names) if shape(a[n].dataType) != shape(b[n].dataType))


def compare(
    spark: SparkSession,
    source: str,
    target: str,
    source_version: int | None = None,
    target_version: int | None = None,
) -> DataFrame:
    """``id, status`` of the rows in which two stored versions differ.

    ``status`` is ``only_source``, ``only_target`` or ``changed``, as :func:`docsync.operators.diff.diff` tells it.
    Missing digests are made. A column that one table lacks compares as null; columns of one
    name need one type (:class:`NotComparable`). An id repeated in a table is the same only when
    all copies agree and the tables hold equally many of them, else it is ``changed``.
    """
    commits = [store.read_commit(spark, r, v) for r, v in ((source, source_version), (target, target_version))]
    schemas = [store.schema_of(c) for c in commits]
    wrong = mismatched(*schemas)
    if wrong:
        raise NotComparable(f"types differ in {', '.join(wrong)}: compare the rows with diff")
    sides = [(root, c["version"]) for root, c in zip((source, target), commits, strict=True)]
    records = [keep(spark, *side) for side in sides]
    if records[0]["total"] == records[1]["total"]:
        return spark.createDataFrame([], T.StructType([schemas[0]["id"], T.StructField("status", T.StringType())]))
    common = math.gcd(*(r["buckets"] for r in records))
    differing = _differing(*(ranges_of(spark, *side, common) for side in sides))
    # At most one number for each bucket, that is for each file of the base.
    numbers = {r["bucket"] for r in differing.select("bucket").distinct().collect()}
    narrow = []
    for side, record in zip(sides, records, strict=True):
        opened = [b for b in range(record["buckets"]) if b % common in numbers]
        some = prints(spark, *side, opened if len(opened) < record["buckets"] else None)
        some = some.withColumns(_range_columns(common)).join(differing, ["bucket", "part"], "left_semi")
        narrow.append(some.select("id", "h1", "h2"))
    return statuses(*narrow, counted=True).where("status <> 'same'")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``bucket, part`` of ranges whose sums differ; a range that one side lacks has sums of 0."""
    minus = [(-F.col(c)).alias(c) for c in SUMS]
    both = a.select("bucket", "part", *SUMS).unionByName(b.select("bucket", "part", *minus))
    sums = both.groupBy("bucket", "part").agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.where(" or ".join(f"{c} <> 0" for c in SUMS)).select("bucket", "part")
