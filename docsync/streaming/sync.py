"""Incremental pass over files of changes, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.operators.apply import latest
from docsync.functions import fingerprint, to_document
from docsync.operators.extract import touched
from docsync.operators.journal import number, preimage
from docsync.operators.outcome import rejected
from docsync.operators.schema import align, misfit
from docsync.session import materialize, tune
from docsync.sources import store
from docsync.sources.journal_store import append_journal


def sync_once(
    spark: SparkSession,
    changes_path: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    journal: str,
    dead: str,
    order: str,
    name: str = "stream",
    files_per_batch: int | None = None,
) -> int:
    """Applies all change files that are new since the last pass, then stops.

    The files hold whole rows in Parquet, with ``schema``; ``order`` decides between versions
    of one row. Each micro-batch is one change set with its journal batch; rows that do not fit
    the target go to ``dead``. A batch that is delivered again after a failure is recognised by
    its number. Returns the target's version.
    """
    tune(spark)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        _apply_batch(batch, batch_id, target, journal, dead, order, name)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(changes_path)
        .writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.current_version(spark, target)


def _apply_batch(
    batch: DataFrame,
    batch_id: int,
    target: str,
    journal: str,
    dead: str,
    order: str,
    name: str,
) -> None:
    spark = batch.sparkSession
    commit = store.read_commit(spark, target)
    tag = {"run_id": name, "batch": f"{batch_id}"}
    if store.find_commit(spark, target, tag) is not None:
        return
    schema = store.schema_of(commit)
    newest = materialize(latest(batch, order).withColumn("_reject", misfit(batch, schema)), name)
    document = to_document([F.col(f"`{c}`") for c in batch.columns])
    refused = newest.where("_reject is not null").select(
        "id", F.col("_reject").alias("reject"), document.alias("source")
    )
    rejected(refused, "delta").write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")
    rows = align(newest.where("_reject is null").drop("_reject"), schema)
    before = store.read_table(spark, target, commit["version"])
    # The table is read once: the stored rows of the batch's ids decide what is newer and are the images.
    held = materialize(touched(before, rows), name)
    changes = _newer(rows, held, order).withColumn("op", F.lit("index"))
    staged = store.stage_changes(changes, target)
    layer = store.read_layer(spark, target, staged, commit)
    images = preimage(number(layer.select("id")), before, "delta", rows=held)
    # Numbers of a batch follow those of all earlier batches.
    images = images.withColumn("seq", F.col("seq") + F.lit(batch_id) * F.lit(1 << 40))
    append_journal(images, journal, name, f"{batch_id}", uncommitted=True)
    store.commit_changes(spark, target, staged, commit["version"], tag)


def _newer(rows: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """Rows that are newer than what is held under their id, so that late files do no harm.

    Equally new rows are told apart by content hash, as within a batch.
    """
    hashed = lambda df: fingerprint(df, [c for c in df.columns if c != "id"])
    held = held.select("id", F.struct(F.col(order).alias("o"), hashed(held).alias("h")).alias("_held"))
    own = F.struct(F.col(order).alias("o"), hashed(rows).alias("h"))
    joined = rows.withColumn("_own", own).join(held, "id", "left")
    return joined.where(F.col("_held").isNull() | (F.col("_own") > F.col("_held"))).select(*rows.columns)
