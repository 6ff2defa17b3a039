"""Physical plans: what is pushed down, what is shuffled, what is broadcast."""

import datetime as dt
import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from docsync.functions import hash_text
from docsync.operators import apply, checks, diff, extract, journal
from docsync.sources import journal_store, store
from queries import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "id string, n int, t string, ts timestamp"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


@contextmanager
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark, low, high):
    i = F.col("i")
    return spark.range(low, high).toDF("i").select(
        F.concat(F.lit("d"), i.cast("string")).alias("id"), i.cast("int").alias("n"),
        hash_text(i).alias("t"), F.timestamp_seconds(i * 1000).alias("ts"),
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored") / "table")
    store.write_version(rows(spark, 0, 1000), root, buckets=4)
    change = rows(spark, 990, 1010).withColumn("op", F.lit("index"))
    name = store.stage_changes(change, root)
    store.commit_changes(spark, root, name)
    return root, name


def test_delta_filter_reaches_the_scan(spark, tmp_path):
    rows(spark, 0, 100).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    text = plan(extract.delta(df, "ts", dt.datetime(1970, 1, 1, 1)))
    assert "GreaterThan(ts" in text.split("PushedFilters")[1]
    assert "ReadSchema: struct<id:string>" in plan(extract.live_ids(df))


def test_reading_a_version_needs_no_shuffle(spark, stored):
    with no_broadcast(spark):
        table = store.read_table(spark, stored[0])
        assert exchanges(table) == 0
        assert exchanges(table.groupBy("id").count()) == 0
    assert table.count() == 1010


def test_folding_changes_into_a_base_needs_no_shuffle(spark, stored):
    with no_broadcast(spark):
        assert exchanges(store.read_table(spark, stored[0]).repartition(4, "id")) == 0


def test_key_check_of_staged_changes_needs_no_shuffle(spark, stored):
    assert exchanges(checks.bad_keys(store.read_layer(spark, *stored))) == 0


def test_pre_images_leave_the_table_where_it_is(spark, stored):
    with no_broadcast(spark):
        table, layer = store.read_table(spark, stored[0]), store.read_layer(spark, *stored)
        old = store.matching(table, layer)
        assert exchanges(old) == 0 and old.count() == 20
        text = plan(journal.preimage(layer.select("id"), table, "delta", rows=old))
        # Rows are turned into JSON above the semi join, that is for listed ids only.
        assert text.index("StructsToJsonEvaluator") < text.index("LeftSemi")


def test_small_change_sets_are_broadcast(spark, stored):
    table, few = rows(spark, 0, 1000), rows(spark, 5, 9)
    for df in (
        apply.apply_upserts(table, few),
        apply.apply_deletes(table, few),
        extract.touched(table, few),
        apply.repair_rows(table, few),
    ):
        assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)


def test_comparison_shuffles_ids_and_hashes_only(spark):
    text = plan(diff.diff(rows(spark, 0, 9), rows(spark, 0, 9)))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    assert "partial_max" in text and "SortAggregate" not in text
    ids = plan(diff.presence(rows(spark, 0, 9), rows(spark, 0, 9)))
    assert "Join" not in ids and ids.count("Exchange hashpartitioning") == 1


def test_first_images_aggregate_no_documents(spark):
    records = spark.createDataFrame([(1, "a", "delta", 1, "{}", None)], "seq bigint, id string, op string, found int, source string, routing string")
    text = plan(journal.first_images(records))
    assert "SortAggregate" not in text and "min_by" not in text


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """A journal of two bucketed batches; the second replays part of the first."""
    root = str(tmp_path_factory.mktemp("journal"))
    for batch, (low, high, base) in {"delta-0": (0, 40, 0), "reconcile": (30, 50, 40)}.items():
        old = F.to_json(F.struct(F.lit(base + 1).alias("n"), "t"))
        images = journal.number(rows(spark, low, high), base).select(
            "seq", "id", F.lit("delta").alias("op"), F.lit(1).alias("found"), old.alias("source"), F.lit(None).alias("routing")
        )
        journal_store.append_journal(images, root, "r", batch, uncommitted=True, buckets=4)
    return root


def test_bucketed_journal_is_undone_in_place(spark, batches, stored):
    """No exchange from the journal to the change set's buckets."""
    with no_broadcast(spark):
        read = journal_store.read_journal(spark, batches, "r")
        first = journal.first_images(read)
        changes = journal.undo_changes(read, store.schema_of(store.read_commit(spark, stored[0])))
        assert exchanges(first) == 0
        assert exchanges(changes.repartition(4, "id")) == 0
    assert first.count() == 50 and first.where("seq > 40").count() == 10
    assert {r["n"] for r in changes.select("n").collect()} == {1, 41}


def test_journal_of_plain_and_bucketed_batches(spark, tmp_path):
    images = spark.createDataFrame([(1, "a", "delta", 1, "{}", None)], journal_store.JOURNAL)
    root = f"{tmp_path}/it's"
    journal_store.append_journal(images, root, "r", "a", buckets=4)
    journal_store.append_journal(images.withColumn("seq", F.lit(2)), root, "r", "b")
    assert not journal_store.append_journal(images, root, "r", "a", buckets=2)
    # Written again, a batch keeps its number of buckets.
    for buckets in (2, None):
        assert journal_store.append_journal(images, root, "r", "a", uncommitted=True, buckets=buckets)
        read = journal_store.read_journal(spark, root, "r")
        assert sorted((r["seq"], r["id"]) for r in read.collect()) == [(1, "a"), (2, "a")]
    assert journal.first_images(read).count() == 1


def test_numbering_has_no_global_sort(spark):
    text = plan(journal.number(rows(spark, 0, 100).select("id")))
    # The only single-partition step works on the counted groups, which are at most 65,536.
    single = text.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[_group" in single[1].split("\n")[1]
    assert "rangepartitioning" not in text


def test_sample_and_page_are_top_k(spark):
    df = rows(spark, 0, 100)
    assert "TakeOrderedAndProject" in plan(checks.sample(df, 5))
    assert "TakeOrderedAndProject" in plan(extract.page(df, "ts", None, 5))


def test_no_cross_joins_in_the_library(spark):
    table, few = rows(spark, 0, 100), rows(spark, 5, 9)
    report = checks.verify(table, few, table, few.select("id"), few.select("id"), sample_ids=checks.sample(table, 5), full=True)
    assert "CartesianProduct" not in plan(report) and "NestedLoop" not in plan(report)


def test_sampled_ids_prune_buckets(spark, stored):
    with no_broadcast(spark):
        table = store.read_table(spark, stored[0])
        text = plan(table.where(F.col("id").isin(["d1"])))
    assert "SelectedBucketsCount: 1 out of 4" in text


def test_change_feed_reads_change_sets_alone(spark, stored):
    """No exchange and no file of the base."""
    feed = store.changes_between(spark, stored[0], 1)
    base = store.read_commit(spark, stored[0])["base"]
    assert exchanges(feed) == 0 and feed.inputFiles() and not any(base in f for f in feed.inputFiles())


def test_tasks_of_id_shuffles_stay_small(spark):
    """Rows of a task do not grow with the table: shuffled ids are small, and hash tables of them are not."""
    ids = spark.range(6_000_000).select(F.xxhash64("id").alias("id"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tasks = ids.distinct().groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(t["count"] for t in tasks) == 6_000_000
    assert max(t["count"] for t in tasks) < 1_200_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("query, joins", [(compare.q_undo, 4), (compare.q_verify, 4)])
def test_steps_of_a_run_are_staged(spark, query, joins):
    """A task holds the hash tables of all joins and groupings of its stage: no plan spans the steps of a run."""
    assert plan(query(spark, SF)).count("Join ") <= joins
