"""Interchange files of change sets, and parts limited in bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions.types import struct_of
from docsync.session import materialize

# Fixed value: largest write request in bytes.
BYTE_CAP = 5_000_000


def action_line(op="op", key="id", routing="routing"):
    """``{"index":{"_id":..., "routing":...}}``; the routing only when there is one."""
    meta = F.struct(F.col(key).cast("string").alias("_id"), F.col(routing).alias("routing"))
    return F.when(F.col(op) == "delete", F.to_json(F.struct(meta.alias("delete")))).otherwise(
        F.to_json(F.struct(meta.alias("index")))
    )


def pair_bytes(action, source):
    """Bytes of an action line and its source line with their line ends."""
    return F.octet_length(action) + F.coalesce(F.octet_length(source), F.lit(0)) + 2


def write_ndjson(changes: DataFrame, path: str, two_lines: bool = False) -> None:
    """Writes ``op, id, routing, doc`` (JSON text).

    The default is one object per line, which any reader can split. ``two_lines`` writes the
    action and, unless it is a delete, the source on the next line; both are one text value, so
    nothing can come between them. These files are gzipped, so that no reader splits them.
    """
    if not two_lines:
        lines = changes.select(
            F.to_json(F.struct("op", F.col("id").cast("string").alias("id"), "routing", "doc"))
        )
        lines.toDF("value").write.text(path)
        return
    source = F.when(F.col("op") != "delete", F.coalesce("doc", F.lit("{}")))
    lines = changes.select(F.concat_ws("\n", action_line(), source))
    lines.toDF("value").write.option("compression", "gzip").text(path)


CHANGE = struct_of(op="string", id="string", routing="string", doc="string")


def read_ndjson(spark: SparkSession, path: str, two_lines: bool = False) -> DataFrame:
    """Reads a change set back.

    In the two-line form a source belongs to the line before it. The files must be compressed, as
    written here: such a file is read by one task, line by line and in order, however long it is.
    Blank lines are skipped.
    """
    if not two_lines:
        return spark.read.schema(CHANGE).json(path)
    lines = spark.read.text(path)
    plain = [f for f in lines.inputFiles() if not f.endswith((".gz", ".zst", ".snappy", ".lz4", ".deflate"))]
    if plain:
        raise ValueError(f"two-line files must be compressed to be read in order: {plain[0]}")
    pairs = lines.mapInArrow(_pair_lines, "action string, doc string")
    meta = F.from_json("action", "map<string, struct<_id: string, routing: string>>")
    op = F.map_keys("m")[0]
    return pairs.select(meta.alias("m"), "doc").select(
        op.alias("op"), F.col("m")[op]["_id"].alias("id"), F.col("m")[op]["routing"].alias("routing"), "doc"
    )


DELETE_LINE = re.compile(r'\s*\{\s*"delete"')


def _pair_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each action line with the source line behind it; deletes have none."""
    action = None
    for batch in batches:
        actions, docs = [], []
        for line in batch.column(0).to_pylist():
            if not line.strip():
                continue
            if action is None and not DELETE_LINE.match(line):
                action = line
                continue
            actions.append(line if action is None else action)
            docs.append(None if action is None else line)
            action = None
        yield pa.RecordBatch.from_arrays([pa.array(actions, pa.string()), pa.array(docs, pa.string())], names=["action", "doc"])
    if action is not None:
        # An action at the end of the input lost its source.
        yield pa.RecordBatch.from_arrays([pa.array([action]), pa.array(["{}"])], names=["action", "doc"])


def pack(df: DataFrame, cap: int = BYTE_CAP, size: str = "size") -> DataFrame:
    """Adds ``part_no``: consecutive rows of a Spark partition, at most ``cap`` bytes together.

    A row larger than the cap stands alone. Every Spark partition starts its own parts, so
    packing needs no shuffle; rows pass through as Arrow batches and only ``size`` is looked at.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part_no", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for n in batch.column(size).to_pylist():
                if filled > 0 and filled + n > cap:
                    part, filled = part + 1, 0
                filled += n
                numbers.append(part)
            columns = [*batch.columns, pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part_no"])

    return df.mapInArrow(assign, schema)


def running_bytes(df: DataFrame, part: str, size: str = "size", order: str = "id") -> DataFrame:
    """Adds ``running``: bytes of a part up to and including each row.

    A window over whole parts would put a part that holds most rows into one task. Rows are
    split into ranges of (part, order) instead, so that a large part spans many chunks; each
    chunk is summed on its own and the sums of the chunks before it are added. The chunks are
    written once, because range boundaries are sampled and may differ when computed again.
    """
    ranged = df.repartitionByRange(part, order).withColumn("_chunk", F.spark_partition_id())
    chunks = materialize(ranged, "running")
    before = (
        Window.partitionBy(part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        chunks.groupBy(part, "_chunk")
        .agg(F.sum(size).alias("_sum"))
        .select(part, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy(part, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = chunks.withColumn("_upto", F.sum(size).over(inside))
    return summed.join(offsets, [part, "_chunk"]).select(
        *df.columns, (F.col("_upto") + F.col("_offset")).cast("bigint").alias("running")
    )


PARTS_PER_FILE = 64


def write_parts(
    changes: DataFrame, path: str, cap: int = BYTE_CAP, parts_per_file: int = PARTS_PER_FILE
) -> None:
    """Two-line files of several parts each, a blank line behind each part.

    No part is larger than ``cap`` unless it is one row. A part is one text value of the writer.
    """
    source = F.when(F.col("op") != "delete", F.coalesce("doc", F.lit("{}")))
    sized = changes.select(
        action_line().alias("action"), source.alias("source")
    ).withColumn("size", pair_bytes(F.col("action"), F.col("source")))
    lines = pack(sized, cap).select("part_no", F.concat_ws("\n", "action", "source").alias("value"))
    parts = lines.mapInArrow(_join_parts, "value string")
    parts.write.option("compression", "gzip").option("lineSep", "\n\n").option(
        "maxRecordsPerFile", str(parts_per_file)
    ).text(path)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part number, which follow each other, as one text."""
    current, lines = None, []
    for batch in batches:
        done = []
        for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != current and lines:
                done.append("\n".join(lines))
                lines = []
            current = part
            lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["value"])
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)])], names=["value"])
