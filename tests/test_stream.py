"""Incremental passes over change files."""

import datetime as dt
from unittest import mock

from pyspark.sql import functions as F

from docsync.operators.apply import latest
from docsync.operators.journal import audit, duplicate_seqs, undo
from docsync.sources import store
from docsync.sources.journal_store import read_journal
from docsync.streaming import sync
from docsync.streaming.sync import _apply_batch, sync_once

SCHEMA = "id string, title string, updated_at timestamp"
T0 = dt.datetime(2026, 7, 1)


def rows(spark, values, hour=0):
    return spark.createDataFrame([(i, t, T0 + dt.timedelta(hours=hour)) for i, t in values], SCHEMA)


def setup(spark, home):
    root = f"{home}/t"
    store.write_version(rows(spark, [(f"d{i}", "old") for i in range(10)]), root, buckets=4)
    return root


def one_pass(spark, home, root, schema=None):
    schema = schema or spark.createDataFrame([], SCHEMA).schema
    return sync_once(spark, f"{home}/in", schema, root, f"{home}/cp", f"{home}/j", f"{home}/dead", "updated_at")


def titles(spark, root):
    return {r["id"]: r["title"] for r in store.read_table(spark, root).collect()}


def test_passes_pick_up_only_new_files(spark, home):
    root = setup(spark, home)
    before = store.read_table(spark, root, 1)
    rows(spark, [("d1", "a"), ("d11", "a")], 1).write.mode("append").parquet(f"{home}/in")
    first = one_pass(spark, home, root)
    assert one_pass(spark, home, root) == first
    later = rows(spark, [("d1", "c")], 3).unionByName(rows(spark, [("d1", "b"), ("d2", "b")], 2))
    later.write.mode("append").parquet(f"{home}/in")
    assert one_pass(spark, home, root) == first + 1
    got = titles(spark, root)
    assert (got["d1"], got["d2"], got["d11"], len(got)) == ("c", "b", "a", 11)
    journal = read_journal(spark, f"{home}/j", "stream")
    assert duplicate_seqs(journal).count() == 0
    assert {(r["op"], r["found"]): r["n"] for r in audit(journal).collect()} == {("delta", 1): 3, ("delta", 0): 1}
    back = undo(store.read_table(spark, root), journal)
    assert sorted(back.collect()) == sorted(before.collect())


def test_late_older_row_does_not_replace_a_newer_one(spark, home):
    root = setup(spark, home)
    args = (root, f"{home}/j", f"{home}/dead", "updated_at", "stream")
    _apply_batch(rows(spark, [("d1", "new")], 5), 1, *args)
    _apply_batch(rows(spark, [("d1", "late"), ("d2", "fresh")], 3), 2, *args)
    assert (titles(spark, root)["d1"], titles(spark, root)["d2"]) == ("new", "fresh")
    # A foreign commit in between: the batch is still known.
    store.write_version(store.read_table(spark, root), root)
    version = store.current_version(spark, root)
    _apply_batch(rows(spark, [("d2", "again")], 9), 2, *args)
    assert store.current_version(spark, root) == version


def test_equally_new_rows_are_told_apart_by_content(spark, home):
    for order in (["a", "b"], ["b", "a"]):
        root = setup(spark, f"{home}/{order[0]}")
        for n, title in enumerate(order):
            _apply_batch(rows(spark, [("d1", title)], 5), n, root, f"{home}/{order[0]}/j", f"{home}/{order[0]}/dead", "updated_at", "s")
        winner = titles(spark, root)["d1"]
        both = rows(spark, [("d1", t) for t in order], 5)
        assert latest(both, "updated_at").first()["title"] == winner


def test_redelivered_batch_changes_nothing(spark, home):
    root = setup(spark, home)
    batch = rows(spark, [("d1", "a")], 1)
    for _ in range(2):
        _apply_batch(batch, 7, root, f"{home}/j", f"{home}/dead", "updated_at", "stream")
    assert store.current_version(spark, root) == 2
    assert read_journal(spark, f"{home}/j", "stream").count() == 1


def test_rows_that_do_not_fit_are_set_aside(spark, home):
    root = f"{home}/t"
    start = rows(spark, [("d0", "x")]).withColumn("title", F.lit(1))
    store.write_version(start, root, buckets=4)
    rows(spark, [("d1", "2"), ("d2", "two")], 1).write.parquet(f"{home}/in")
    one_pass(spark, home, root)
    assert titles(spark, root) == {"d0": 1, "d1": 2}
    dead = spark.read.json(f"{home}/dead").collect()
    assert [(r["_id"], r["error"]["type"]) for r in dead] == [("d2", "mapper_parsing_exception")]


def test_images_come_from_the_one_read_of_the_table(spark, home):
    root = setup(spark, home)
    base = store.read_commit(spark, root)["base"]
    with mock.patch.object(sync, "preimage", wraps=sync.preimage) as images:
        _apply_batch(rows(spark, [("d1", "a"), ("d11", "a")], 1), 1, root, f"{home}/j", f"{home}/dead", "updated_at", "stream")
    assert not any(base in name for name in images.call_args.kwargs["rows"].inputFiles())
    assert {(r["id"], r["found"]) for r in read_journal(spark, f"{home}/j", "stream").collect()} == {("d1", 1), ("d11", 0)}
