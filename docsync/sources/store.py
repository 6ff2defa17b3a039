"""Versioned document tables on Parquet.

A version is a base snapshot plus the change sets applied since. Base and change sets are
bucketed by ``id`` into the same number of buckets, so reading a version (base without the
changed ids, plus the changed rows) and comparing or joining versions by id needs no shuffle of
the documents. Applying a change set costs as much as the change set, not as much as the table.
After ``MOST_LAYERS`` change sets they are folded into one change set, which costs as much as
they hold; a new base is only written when :func:`compact` is called.

A version becomes visible by one small commit file that only one writer can create. Nothing that
a reader may have open is ever changed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.session import fresh_dir
from docsync.sources import files

MOST_LAYERS = 8
# Ids that a lookup states as literals; beyond, they are joined.
MOST_LITERALS = 1024
OP = "_op"


class CommitConflict(RuntimeError):
    """Another writer moved the table first."""


# ---- bucketed folders --------------------------------------------------------------------


def _table_name() -> str:
    return f"docsync_{uuid.uuid4().hex}"


def write_bucketed(
    df: DataFrame, path: str, buckets: int, key: str = "id", replace: bool = False, index: bool = False
) -> None:
    """One file per bucket below ``path``, sorted by id; ``replace`` overwrites what is there.

    Only ``saveAsTable`` can write buckets, so the folder is registered for the moment of the
    write; dropping an external table leaves its files. Rows that lie by bucket already stay
    where they are. ``index`` gives each row group a Bloom filter of its ids, as large as they need.
    """
    spark, name = df.sparkSession, _table_name()
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .mode("overwrite" if replace else "errorifexists")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .option(f"parquet.bloom.filter.enabled#{key}", str(index).lower())
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")


def _ddl(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        inner = ", ".join(f"`{f.name}`: {_ddl(f.dataType)}" for f in dtype.fields)
        return f"STRUCT<{inner}>"
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{_ddl(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"MAP<{_ddl(dtype.keyType)}, {_ddl(dtype.valueType)}>"
    return dtype.simpleString()


def read_bucketed(
    spark: SparkSession, path: str, schema: T.StructType, buckets: int, key: str = "id"
) -> DataFrame:
    """Reads such a folder so that joins and aggregates by id use the buckets."""
    name = _table_name()
    columns = ", ".join(f"`{f.name}` {_ddl(f.dataType)}" for f in schema.fields)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return df


# ---- versions ----------------------------------------------------------------------------


def _commit_path(root: str, version: int) -> str:
    return f"{root}/_commits/{version:010d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Visible versions, oldest first."""
    listed = [n for n in files.names(spark, f"{root}/_commits") if n.endswith(".json")]
    return [int(n.split(".")[0]) for n in listed]


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The commit record of a version, by default the newest one."""
    if version is not None:
        return files.read_json(spark, _commit_path(root, version))
    for candidate in reversed(versions(spark, root)):
        record = files.read_json(spark, _commit_path(root, candidate))
        if record is not None:
            return record
    raise FileNotFoundError(f"no version at {root}")


def current_version(spark: SparkSession, root: str) -> int:
    """Newest visible version, 0 when the table does not exist yet."""
    try:
        return read_commit(spark, root)["version"]
    except FileNotFoundError:
        return 0


def _commit(spark: SparkSession, root: str, after: int, record: dict) -> int:
    # A commit file is renamed into place whole. One that cannot be read may still belong to a
    # live writer of another kind, so it blocks as well.
    taken = [v for v in versions(spark, root) if v > after]
    if taken:
        raise CommitConflict(f"{root} is at version {taken[-1]}, expected {after}")
    version = after + 1
    record = {
        **record,
        "version": version,
        "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(),
    }
    if not files.create_json(spark, _commit_path(root, version), record):
        raise CommitConflict(f"version {version} of {root} was written by another process")
    return version


def find_commit(spark: SparkSession, root: str, tag: dict, after: int = 0) -> dict | None:
    """The commit with this tag among the versions above ``after``, newest first."""
    for version in reversed([v for v in versions(spark, root) if v > after]):
        record = read_commit(spark, root, version)
        if record is not None and record["tag"] == tag:
            return record
    return None


def write_version(
    df: DataFrame,
    root: str,
    buckets: int | None = None,
    tag: dict | None = None,
    expect: int | None = None,
    compacted: bool = False,
) -> int:
    """Writes ``df`` as a complete new version and returns its number.

    ``compacted`` says that the rows are those of the version before. ``buckets`` should give files of about one GB at the table's size; an existing table keeps
    its number unless another one is named.
    """
    spark = df.sparkSession
    after = current_version(spark, root) if expect is None else expect
    if after and not buckets:
        buckets = read_commit(spark, root, after)["buckets"]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = f"base-{uuid.uuid4().hex}"
    write_bucketed(df, f"{root}/{data}", buckets, index=True)
    record = {
        "base": data,
        "rows": read_bucketed(spark, f"{root}/{data}", df.schema, buckets).count(),
        "bytes": files.size(spark, f"{root}/{data}"),
        "layers": [],
        "change": None,
        "compacted": compacted,
        "buckets": buckets,
        "schema": df.schema.jsonValue(),
        "tag": tag or {},
    }
    return _commit(spark, root, after, record)


def schema_of(commit: dict) -> T.StructType:
    return T.StructType.fromJson(commit["schema"])


def layer_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(OP, T.StringType()), *schema.fields])


def stage_changes(changes: DataFrame, root: str, schema: T.StructType | None = None) -> str:
    """Writes a change set next to the table without making it visible; returns its name.

    ``changes`` has the table's columns and ``op`` (``index`` or ``delete``), each id once.
    ``schema`` is the table's schema from this change set on, when it gains columns.
    """
    spark = changes.sparkSession
    commit = read_commit(spark, root)
    schema = schema or schema_of(commit)
    name = f"chg-{uuid.uuid4().hex}"
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    rows = changes.select(F.col("op").alias(OP), *columns)
    write_bucketed(rows, f"{root}/{name}", commit["buckets"], index=True)
    return name


def read_layer(spark: SparkSession, root: str, name: str, commit: dict | None = None) -> DataFrame:
    """A staged or committed change set: ``_op`` and the table's columns."""
    commit = commit or read_commit(spark, root)
    return read_bucketed(
        spark, f"{root}/{name}", layer_schema(schema_of(commit)), commit["buckets"]
    )


def commit_changes(
    spark: SparkSession,
    root: str,
    name: str,
    expect: int | None = None,
    tag: dict | None = None,
    schema: T.StructType | None = None,
) -> int:
    """Makes a staged change set visible as the next version."""
    after = current_version(spark, root) if expect is None else expect
    commit = read_commit(spark, root, after)
    if schema is not None:
        commit = {**commit, "schema": schema.jsonValue()}
    layers = [*commit["layers"], name]
    if len(layers) > MOST_LAYERS:
        layers = [_fold(spark, root, {**commit, "layers": layers})]
    change = {"change": name, "compacted": False}
    return _commit(spark, root, after, {**commit, **change, "layers": layers, "tag": tag or {}})


def _fold(spark: SparkSession, root: str, commit: dict) -> str:
    """One change set with the effect of all of a commit's; the base is not read."""
    layers = [read_layer(spark, root, name, commit) for name in commit["layers"]]
    name = f"chg-{uuid.uuid4().hex}"
    write_bucketed(_net(layers), f"{root}/{name}", commit["buckets"], index=True)
    return name


def _net(layers: list[DataFrame]) -> DataFrame:
    """The last change of each id over change sets from old to new; they meet bucket by bucket."""
    rows = layers[0]
    for layer in layers[1:]:
        rows = rows.join(layer.select("id"), "id", "left_anti").select(*rows.columns).unionByName(layer)
    return rows


class NoChangeFeed(LookupError):
    """A version in between was written whole, so that its changes are not recorded."""


def changes_between(
    spark: SparkSession, root: str, after: int, upto: int | None = None, kinds: bool = False
) -> DataFrame:
    """Net effect of the change sets committed after version ``after``, up to ``upto`` (the newest).

    ``change`` is ``upsert`` or ``delete``, with the columns of version ``upto``; a deleted row has only
    its id. Each id comes once, whatever happened to it in between. Only the change sets are read,
    without an exchange of their rows; not the base, and no timestamps.

    ``kinds`` tells ``insert`` from ``update`` and leaves out deletes of ids that version ``after`` did not
    hold, for which the ids of that version are read. Compactions and folds in between change
    nothing; a version that was written whole raises :class:`NoChangeFeed`.
    """
    listed = versions(spark, root)
    upto = upto or (listed[-1] if listed else 0)
    if upto not in listed or after not in [0, *listed] or after > upto:
        raise LookupError(f"{root} has no versions {after} to {upto}")
    last, layers = read_commit(spark, root, upto), []
    for version in range(after + 1, upto + 1):
        if version not in listed:
            raise NoChangeFeed(f"version {version} of {root} is gone")
        commit = read_commit(spark, root, version)
        if commit.get("change"):
            layers.append((commit["change"], {**commit, "schema": last["schema"]}))
        elif not commit.get("compacted"):
            raise NoChangeFeed(f"version {version} of {root} was written whole: compare the versions")
    schema = schema_of(last)
    sets = [read_layer(spark, root, name, commit) for name, commit in layers]
    while len(sets) > MOST_LAYERS:
        # Long histories are folded in steps, so that no plan grows with them.
        path = fresh_dir(spark, "net-changes")
        write_bucketed(_net(sets[:MOST_LAYERS]), path, last["buckets"])
        sets = [read_bucketed(spark, path, layer_schema(schema), last["buckets"]), *sets[MOST_LAYERS:]]
    rows = _net(sets) if sets else spark.createDataFrame([], layer_schema(schema))
    payload = [F.col(f"`{f.name}`") for f in schema.fields]
    change = F.when(F.col(OP) == "delete", "delete").otherwise("upsert")
    if not kinds:
        return rows.select(change.alias("change"), *payload)
    held = read_table(spark, root, after).select("id") if after else spark.createDataFrame([], T.StructType([schema["id"]]))
    known = held.join(rows.select("id"), "id", "left_semi").withColumn("_known", F.lit(True))
    rows = rows.join(known, "id", "left")
    kind = F.when(F.col(OP) == "delete", F.when(F.col("_known"), "delete")).when(F.col("_known"), "update").otherwise("insert")
    return rows.withColumn("change", kind).where("change is not null").select("change", *payload)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live rows of one version; a running read never sees later changes."""
    commit = read_commit(spark, root, version)
    schema = schema_of(commit)
    rows = read_bucketed(spark, f"{root}/{commit['base']}", schema, commit["buckets"])
    for name in commit["layers"]:
        rows = overlay(rows, read_layer(spark, root, name, commit))
    return rows


def lookup(spark: SparkSession, root: str, ids: Sequence, version: int | None = None) -> DataFrame:
    """The live rows of the given ids; ids that the version lacks, and nulls, give none.

    What is read follows from the ids: of the base and of each change set, the files of their
    buckets, and in these the row groups whose range and Bloom filter let one of them pass. More than
    ``MOST_LITERALS`` ids are joined instead, which reads all ids.
    """
    rows = read_table(spark, root, version)
    kind = rows.schema["id"].dataType
    asked = sorted({i for i in ids if i is not None})
    if len(asked) > MOST_LITERALS:
        listed = spark.createDataFrame([(i,) for i in asked], T.StructType([T.StructField("id", kind)]))
        return rows.join(listed, "id", "left_semi").select(*rows.columns)
    return rows.where(F.col("id").isin([F.lit(i).cast(kind) for i in asked]) if asked else F.lit(False))


def overlay(rows: DataFrame, layer: DataFrame) -> DataFrame:
    """Rows with one change set on top."""
    kept = rows.join(layer.select("id"), "id", "left_anti").select(*rows.columns)
    written = layer.where(F.col(OP) == "index").select(*rows.columns)
    return kept.unionByName(written)


def matching(rows: DataFrame, layer: DataFrame) -> DataFrame:
    """Rows of a version that a change set touches; both meet bucket by bucket."""
    return rows.join(layer.select("id"), "id", "left_semi").select(*rows.columns)


def compact(
    spark: SparkSession,
    root: str,
    tag: dict | None = None,
    version: int | None = None,
    buckets: int | None = None,
) -> int:
    """Folds base and change sets of ``version``, the newest by default, into a new base.

    Fails with a conflict when another writer moves the table meanwhile. ``buckets`` deals the
    rows anew, for a table that has outgrown its number.
    """
    commit = read_commit(spark, root, version)
    if not commit["layers"] and buckets in (None, commit["buckets"]):
        return commit["version"]
    rows = read_table(spark, root, commit["version"])
    return write_version(rows, root, buckets, tag=tag or commit["tag"], expect=commit["version"], compacted=True)


def mean_row_bytes(spark: SparkSession, root: str) -> float:
    """Stored bytes per row of the newest base, as recorded when it was written."""
    commit = read_commit(spark, root)
    return commit["bytes"] / commit["rows"] if commit.get("rows") else 0.0


def expire(spark: SparkSession, root: str, before: int) -> list[str]:
    """Removes versions below ``before`` and the folders that only they use; names what went.

    Folders of change sets that are staged but not visible yet belong to no version and stay.
    The newest version always stays. Reads of a removed version that are under way fail.
    """
    listed = versions(spark, root)
    old = [v for v in listed[:-1] if v < before]
    used = lambda vs: {n for v in vs for c in [read_commit(spark, root, v)] for n in (c["base"], *c["layers"], *filter(None, [c.get("change")]))}
    gone = sorted(used(old) - used([v for v in listed if v not in old]))
    for version in old:
        files.remove(spark, _commit_path(root, version))
        files.remove(spark, f"{root}/_digests/{version:010d}")
    for name in gone:
        files.remove(spark, f"{root}/{name}")
        files.remove(spark, f"{root}/_prints/{name}")
    return gone


# ---- markers -----------------------------------------------------------------------------


def set_marker(spark: SparkSession, root: str, key: str, value: str) -> None:
    """Appends a value (such as the cutover time) for a table."""
    moment = dt.datetime.now(dt.timezone.utc).isoformat()
    path = f"{root}/_markers/{uuid.uuid4().hex}.json"
    files.create_json(spark, path, {"key": key, "value": value, "written_at": moment})


def markers(spark: SparkSession, root: str) -> DataFrame:
    """Newest value per key: ``key, value``."""
    if not files.exists(spark, f"{root}/_markers"):
        return spark.createDataFrame([], "key string, value string")
    written = spark.read.schema("key string, value string, written_at string").json(
        f"{root}/_markers"
    )
    return written.groupBy("key").agg(F.max_by("value", "written_at").alias("value"))


def get_marker(spark: SparkSession, root: str, key: str, override: str | None = None) -> str:
    """Value of a marker; an error when there is none and no override is given."""
    if override is not None:
        return override
    row = markers(spark, root).where(F.col("key") == key).first()
    if row is None:
        raise KeyError(f"no marker {key!r} at {root}: pass the value explicitly")
    return row["value"]


__all__ = [
    "MOST_LAYERS", "CommitConflict", "NoChangeFeed", "changes_between", "commit_changes", "compact", "current_version", "expire", "find_commit",
    "get_marker", "lookup", "markers", "matching", "mean_row_bytes", "overlay", "read_bucketed",
    "read_commit", "read_layer", "read_table", "schema_of", "set_marker", "stage_changes",
    "versions", "write_bucketed", "write_version",
]
