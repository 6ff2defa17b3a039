"""Small control files on the shared file system (any Hadoop file system)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to this folder finished."""
    return exists(spark, f"{path}/_SUCCESS")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty when there is no such folder."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """Content of a control file; None when it is not whole."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Writes a new control file; False when it exists, so that one of two writers loses.

    The content goes to a name of its own and is then renamed without overwriting: a file under
    its final name is always whole.
    """
    fs, where = _fs(spark, path)
    if fs.exists(where):
        return False
    jvm = spark.sparkContext._jvm
    fs.mkdirs(where.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(value, default=str), "utf-8"))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(where), plain)
    except Exception as error:  # the JVM error type differs between file systems
        fs.delete(draft, False)
        if fs.exists(where):
            return False
        raise error
    return True
