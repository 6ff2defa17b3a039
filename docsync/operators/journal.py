"""Pre-image journal: what every changed row looked like before, and how to go back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import from_document, hash_text, to_document
from docsync.operators.extract import live_ids, touched

EMPTY = "{}"


def preimage(
    ids: DataFrame,
    target: DataFrame,
    op: str | Column,
    routing: str | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``id, op, found, source`` (and ``routing``) of the rows about to change.

    Rows are serialised for the listed ids only. ``ids`` may carry a ``seq`` column, which is
    kept. ``rows`` are the target's rows for these ids, when the caller has a better way to
    find them.
    """
    payload = [c for c in target.columns if c != routing]
    rows = touched(target, ids) if rows is None else rows
    old = rows.select(
        "id",
        to_document([F.col(f"`{c}`") for c in payload]).alias("_source"),
        (F.col(routing) if routing else F.lit(None)).cast("string").alias("routing"),
    )
    op = F.lit(op) if isinstance(op, str) else op
    lead = ["seq"] if "seq" in ids.columns else []
    return ids.join(old, "id", "left").select(
        *lead,
        "id",
        op.alias("op"),
        F.col("_source").isNotNull().cast("int").alias("found"),
        F.coalesce("_source", F.lit(EMPTY)).alias("source"),
        "routing",
    )


def number(
    df: DataFrame, base: int = 0, by: Sequence[str] = ("id",), seed: int | None = None
) -> DataFrame:
    """Adds a gap-free ``seq`` from ``base + 1`` in the order of md5(``by``), which is a fixed shuffle.

    A plain global ``row_number`` would sort everything in one task. Here the first four hash
    digits put every row into one of 65,536 groups; the groups are counted and ranked on their
    own, and the group offsets, at most 65,536 rows, are broadcast. The result depends on the
    data alone, so a task that is run again gives the same numbers. ``by`` must identify a row.
    """
    salt = [] if seed is None else [seed]
    hashed = df.withColumn("_hash", hash_text(*[F.col(c) for c in by], *salt))
    grouped = hashed.withColumn("_group", F.substring("_hash", 1, 4))
    running = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_group").orderBy("_hash", *by)
    ranked = grouped.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(F.broadcast(offsets), "_group").select(
        (F.lit(base) + F.col("_offset") + F.col("_rank")).cast("bigint").alias("seq"),
        *df.columns,
    )


def first_images(journal: DataFrame) -> DataFrame:
    """Journal row with the lowest seq per id: the state before the run, even after replays.

    The lowest numbers come from ids and numbers alone; documents are not aggregated. They meet by
    id alone, so that a journal bucketed by id is read in place.
    """
    lowest = journal.groupBy("id").agg(F.min("seq").alias("_first"))
    # No number is below the lowest. As an equality this would become a key of the join.
    return journal.join(lowest, "id").where("seq <= _first").select(*journal.columns)


def first_images_ranked(journal: DataFrame) -> DataFrame:
    """The same by ranking. Kept for checks: it sorts whole groups instead of collapsing them."""
    order = Window.partitionBy("id").orderBy("seq")
    return journal.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def audit(journal: DataFrame) -> DataFrame:
    """``op, found, n``."""
    return journal.groupBy("op", "found").agg(F.count(F.lit(1)).alias("n"))


def duplicate_seqs(journal: DataFrame) -> DataFrame:
    """Sequence numbers used more than once; must be empty."""
    counts = journal.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def undo_changes(journal: DataFrame, schema: T.StructType, routing: str | None = None) -> DataFrame:
    """Change set ``op, <columns>`` that restores (``index``) or removes (``delete``) rows."""
    first = first_images(journal)
    doc = from_document(F.col("source"), schema)
    columns = []
    for field in schema.fields:
        value = F.col("_doc")[field.name]
        if field.name == "id":
            value = F.col("id").cast(field.dataType)
        elif field.name == routing:
            value = F.col("routing")
        columns.append(value.alias(field.name))
    return first.withColumn("_doc", F.when(F.col("found") == 1, doc)).select(
        F.when(F.col("found") == 1, "index").otherwise("delete").alias("op"), *columns
    )


def undo(target: DataFrame, journal: DataFrame, routing: str | None = None) -> DataFrame:
    """Target as it was before the journaled changes."""
    changes = undo_changes(journal, target.schema, routing)
    kept = target.join(live_ids(changes), "id", "left_anti").select(*target.columns)
    restored = changes.where("op = 'index'").select(*target.columns)
    return kept.unionByName(restored)
