"""Journal files: Parquet by run and batch, and the tab-separated interchange form.

Batches of a run are bucketed by id like the change sets they belong to. Finding the first image of
each id and turning a journal into a change set then happen bucket by bucket: no document is
exchanged, however often a run was repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions.types import struct_of
from docsync.sources import files, store

JOURNAL = struct_of(
    seq="bigint", id="string", op="string", found="int", source="string", routing="string"
)
# The id's name in bucketed files. The projection back to ``id`` keeps the partitioning known
# above a union of batches, where a filter alone would hide it.
KEY = "bucket_id"
STORED = T.StructType([T.StructField(KEY if f.name == "id" else f.name, f.dataType) for f in JOURNAL.fields])


def batch_path(root: str, run_id: str, batch: str) -> str:
    return f"{root}/run_id={run_id}/batch_id={batch}"


def _record(path: str) -> str:
    """Where the number of buckets of a batch stands; written before the batch, and never changed."""
    run, batch = path.rsplit("/", 1)
    return f"{run}/_buckets-{batch}.json"


def _buckets(spark: SparkSession, path: str) -> int | None:
    dealt = files.read_json(spark, _record(path)) if files.exists(spark, _record(path)) else None
    return dealt["buckets"] if dealt else None


def append_journal(
    df: DataFrame,
    root: str,
    run_id: str,
    batch: str,
    uncommitted: bool = False,
    buckets: int | None = None,
) -> bool:
    """Writes one batch of a run; False when the batch is in the journal already.

    The first complete write of a batch stays: a replay would record rows that the run itself
    has changed. What a failed attempt left behind is overwritten. ``uncommitted`` says that the
    batch's change set is not visible yet, so that its journal is written anew and matches what
    will be made visible. ``buckets`` is the number of buckets of the table; the batch is then
    bucketed by id. A batch that is written again keeps the number it had.
    """
    spark, path = df.sparkSession, batch_path(root, run_id, batch)
    if not uncommitted and files.complete(spark, path):
        return False
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOURNAL.fields])
    if buckets is not None:
        files.create_json(spark, _record(path), {"buckets": buckets})
    buckets = _buckets(spark, path)
    if buckets is None:
        rows.write.mode("overwrite").parquet(path)
    else:
        store.write_bucketed(rows.withColumnRenamed("id", KEY), path, buckets, KEY, replace=True)
    return True


def read_journal(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """All complete batches of one run; other runs never mix in."""
    run = f"{root}/run_id={run_id}"
    batches = [
        f"{run}/{name}"
        for name in files.names(spark, run)
        if name.startswith("batch_id=") and files.complete(spark, f"{run}/{name}")
    ]
    dealt = {path: _buckets(spark, path) for path in batches}
    named = [F.col(KEY if n == "id" else n).alias(n) for n in JOURNAL.names]
    parts = [store.read_bucketed(spark, p, STORED, n, KEY).select(*named) for p, n in dealt.items() if n]
    plain = [p for p, n in dealt.items() if not n]
    if plain:
        parts.append(spark.read.schema(JOURNAL).parquet(*plain))
    out = parts[0] if parts else spark.createDataFrame([], JOURNAL)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_journal_tsv(journal: DataFrame, path: str) -> None:
    """``seq, id, op, found, source`` separated by tabs, gzip. JSON text holds no raw tab."""
    line = F.concat_ws(
        "\t", F.col("seq").cast("string"), "id", "op", F.col("found").cast("string"), "source"
    )
    journal.select(line.alias("value")).write.option("compression", "gzip").text(path)


def read_journal_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Reads the interchange form. Everything behind the fourth tab is the source."""
    part = F.split("value", "\t", 5)
    return spark.read.text(path).select(
        part[0].cast("bigint").alias("seq"),
        part[1].alias("id"),
        part[2].alias("op"),
        part[3].cast("int").alias("found"),
        part[4].alias("source"),
        F.lit(None).cast("string").alias("routing"),
    )
