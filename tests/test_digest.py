"""Digests of stored versions: what they find, and what they read to find it."""

from unittest import mock

import pytest
from pyspark.sql import functions as F

from docsync.operators import diff
from docsync.sources import digest, files, store

SCHEMA = "id string, n int, tags map<string,int>, meta struct<a:int,b:string>"


def rows(spark, low, high, shift=0):
    i = F.col("i")
    return spark.range(low, high).toDF("i").select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"), (i + shift).cast("int").alias("n"),
        F.create_map(F.lit("x"), i.cast("int"), F.lit("y"), F.lit(1)).alias("tags"),
        F.struct(i.cast("int").alias("a"), F.lit("b").alias("b")).alias("meta"),
    )


def found(df):
    return {r["id"]: r["status"] for r in df.collect()}


def brute(a, b):
    return {k: s for k, s in found(diff.diff(a, b)).items() if s != "same"}


def change(spark, root, upserts=None, deletes=()):
    parts = []
    if upserts is not None:
        parts.append(upserts.withColumn("op", F.lit("index")))
    if deletes:
        schema = store.schema_of(store.read_commit(spark, root))
        gone = spark.createDataFrame([(d,) for d in deletes], "id string")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "id"]
        parts.append(gone.select("id", *empty, F.lit("delete").alias("op")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return store.commit_changes(spark, root, store.stage_changes(out, root))


@pytest.fixture
def pair(spark, home):
    """Two tables of 400 equal rows, in 8 and 12 buckets."""
    for name, buckets in (("a", 8), ("b", 12)):
        store.write_version(rows(spark, 0, 400), f"{home}/{name}", buckets=buckets)
    return f"{home}/a", f"{home}/b"


class Reads:
    """Folders that were opened by bucket, without their unique names."""

    def __init__(self):
        self.paths, self.real = [], store.read_bucketed

    def __call__(self, spark, path, *args, **kwargs):
        self.paths.append(path)
        return self.real(spark, path, *args, **kwargs)

    @property
    def documents(self):
        return [p for p in self.paths if "/_prints/" not in p]


def test_equal_tables_read_no_documents(spark, pair):
    for root in pair:
        digest.keep(spark, root)
    with mock.patch.object(store, "read_bucketed", Reads()) as reads:
        assert digest.compare(spark, *pair).isEmpty()
    assert reads.paths == []


def test_one_change_reads_one_common_bucket_and_no_documents(spark, pair):
    change(spark, pair[1], rows(spark, 7, 8, shift=1))
    for root in pair:
        digest.keep(spark, root)
    with mock.patch.object(store, "read_bucketed", Reads()) as reads:
        out = digest.compare(spark, *pair)
        assert found(out) == {"d7": "changed"}
    assert reads.documents == []
    # The only table without change sets opens the changed bucket's 2 of 8 files.
    bucket = [b for b in range(8) if b % 4 == _bucket(spark, "d7", 4)]
    some = digest.prints(spark, pair[0], None, bucket)
    assert "d7" in {r["id"] for r in some.collect()} and some.count() < 400
    leaf = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().get("numFiles").get().value() == 2


def _bucket(spark, key, buckets):
    return spark.range(1).select(F.pmod(F.hash(F.lit(key)), F.lit(buckets)).alias("b")).first()["b"]


def test_finds_what_the_row_comparison_finds(spark, pair):
    a, b = pair
    change(spark, a, rows(spark, 390, 420), [f"d{i}" for i in range(10, 20)])
    change(spark, b, rows(spark, 50, 60, shift=3), ["d399", "nowhere"])
    change(spark, b, rows(spark, 15, 18))
    wanted = brute(store.read_table(spark, a), store.read_table(spark, b))
    assert set(wanted.values()) == {"only_source", "only_target", "changed"}
    assert found(digest.compare(spark, a, b)) == wanted
    # Against an earlier version of itself: what the change sets did.
    assert found(digest.compare(spark, a, a, 1)) == brute(store.read_table(spark, a, 1), store.read_table(spark, a))


def test_rows_that_trade_contents_differ(spark, home):
    plain = spark.createDataFrame([(f"d{i}", i % 2) for i in range(500)], "id string, n int")
    store.write_version(plain, f"{home}/a", buckets=1)
    store.write_version(plain.withColumn("n", 1 - F.col("n")), f"{home}/b", buckets=1)
    assert len(found(digest.compare(spark, f"{home}/a", f"{home}/b"))) == 500


def test_only_the_new_change_set_is_hashed(spark, pair):
    root = pair[0]
    digest.keep(spark, root)
    change(spark, root, rows(spark, 0, 5, shift=1))
    base = store.read_commit(spark, root)["base"]
    with mock.patch.object(store, "read_bucketed", Reads()) as reads:
        digest.keep(spark, root)
    assert len(reads.documents) == 1 and base not in reads.documents[0]


def test_columns_that_come_and_go(spark, home):
    a, b = f"{home}/a", f"{home}/b"
    for root in (a, b):
        store.write_version(spark.range(100).selectExpr("id", "cast(id as int) as n"), root, buckets=2)
        digest.keep(spark, root)
    old = store.schema_of(store.read_commit(spark, a))
    wide = spark.range(0).selectExpr("id", "cast(id as int) as n", "cast(null as string) as note").schema
    extended = spark.createDataFrame([(1, 1, "x"), (2, 2, None)], wide).withColumn("op", F.lit("index"))
    store.commit_changes(spark, a, store.stage_changes(extended, a, wide), schema=wide)
    # A null in the new column is no difference, a value is one.
    assert found(digest.compare(spark, a, b)) == {1: "changed"}
    back = spark.createDataFrame([(1, 1)], old).withColumn("op", F.lit("index"))
    store.commit_changes(spark, a, store.stage_changes(back, a, old), schema=old)
    assert found(digest.compare(spark, a, b)) == {}


def test_repeated_and_null_ids_and_empty_tables(spark, home):
    schema = "id string, n int"
    tables = {
        "empty": [], "one": [("x", 1)], "two": [("x", 1), ("x", 1)], "mixed": [("x", 1), ("x", 2)], "null": [(None, 1)],
    }
    for name, data in tables.items():
        store.write_version(spark.createDataFrame(data, schema), f"{home}/{name}", buckets=2)
    got = lambda a, b: found(digest.compare(spark, f"{home}/{a}", f"{home}/{b}"))
    assert got("empty", "empty") == {}
    assert got("one", "empty") == {"x": "only_source"} and got("empty", "one") == {"x": "only_target"}
    assert got("one", "two") == {"x": "changed"} and got("two", "mixed") == {"x": "changed"}
    assert got("null", "empty") == {None: "only_source"} and got("null", "null") == {}


def test_types_must_agree(spark, home):
    store.write_version(spark.range(3).selectExpr("id", "1 as n"), f"{home}/a", buckets=2)
    store.write_version(spark.range(3).selectExpr("id", "'1' as n"), f"{home}/b", buckets=2)
    with pytest.raises(digest.NotComparable, match="n"):
        digest.compare(spark, f"{home}/a", f"{home}/b")


def test_expired_versions_take_their_digests_along(spark, pair):
    root = pair[0]
    digest.keep(spark, root)
    change(spark, root, rows(spark, 0, 5, shift=1))
    digest.keep(spark, root)
    store.compact(spark, root)
    digest.keep(spark, root)
    gone = store.expire(spark, root, 3)
    assert len(gone) == 2 and len(files.names(spark, f"{root}/_prints")) == 1
    assert files.names(spark, f"{root}/_digests") == ["0000000003"]
    # Compaction changes no row.
    change(spark, pair[1], rows(spark, 0, 5, shift=1))
    assert found(digest.compare(spark, *pair)) == {}


def test_sums_roll_up_to_fewer_buckets(spark, pair):
    fine, coarse = digest.ranges_of(spark, pair[0]), digest.ranges_of(spark, pair[0], buckets=4)
    assert coarse.agg(F.sum("n"), F.sum("s1")).first() == fine.agg(F.sum("n"), F.sum("s1")).first()
    assert {r["bucket"] for r in coarse.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        digest.ranges_of(spark, pair[0], buckets=3)
