"""Lookups by id: what they return and what they read."""

import re

import pytest
from pyspark.sql import functions as F

from docsync.sources import store
from tests.test_plans import no_broadcast, plan, rows


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """20,000 rows in 16 buckets; a change set writes ids from 19,990 to 20,010 and deletes one."""
    path = str(tmp_path_factory.mktemp("lookup") / "table")
    store.write_version(rows(spark, 0, 20000), path, buckets=16)
    written = rows(spark, 19990, 20010).withColumns({"n": F.lit(-1), "op": F.lit("index")})
    gone = rows(spark, 5, 6).withColumn("op", F.lit("delete"))
    store.commit_changes(spark, path, store.stage_changes(written.unionByName(gone), path))
    return path


def scans(df):
    """Rows that came out of each scan of a frame, after it ran."""
    df.collect()
    top = df._jdf.queryExecution().executedPlan()
    found, stack = [], [top.executedPlan() if "Adaptive" in top.nodeName() else top]
    while stack:
        node = stack.pop()
        node = node.plan() if "QueryStage" in node.nodeName() else node
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().get("numOutputRows").get().value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_rows_of_the_newest_version(spark, root):
    got = {r["id"]: r["n"] for r in store.lookup(spark, root, ["d1", "d5", "d19995", "d20009", "nowhere", None, "d1"]).collect()}
    assert got == {"d1": 1, "d19995": -1, "d20009": -1}
    assert {r["n"] for r in store.lookup(spark, root, ["d5", "d19995"], version=1).collect()} == {5, 19995}
    assert store.lookup(spark, root, []).isEmpty() and store.lookup(spark, root, [None]).isEmpty()


def test_many_ids_are_joined(spark, root):
    many = [f"d{i}" for i in range(0, 40000, 7)]
    assert len(many) > store.MOST_LITERALS
    wanted = [i for i in range(0, 20010, 7) if i != 5]
    assert store.lookup(spark, root, many).count() == len(wanted)


def test_a_few_ids_open_a_few_files(spark, root):
    with no_broadcast(spark):
        asked = store.lookup(spark, root, ["d1", "d2", "d3"])
        opened = [int(n) for n in re.findall(r"SelectedBucketsCount: (\d+) out of 16", plan(asked))]
        read = scans(asked)
    # The base, and the change set twice: its ids and its rows. The plan names the buckets of the two that
    # are joined by bucket, at most one for each id.
    assert len(read) == 3 and len(opened) == 2 and max(opened) <= 3
    # Files hold 1,250 rows on average; the change set's filters rule out all three ids.
    assert sorted(read)[:2] == [0, 0] and max(read) < 3 * 1400


def test_absent_ids_read_no_row(spark, root):
    """They lie between the least and the greatest id of their files; the Bloom filters rule them out."""
    absent = [f"d1{i:04d}x" for i in range(0, 2000, 20)]
    with no_broadcast(spark):
        read = scans(store.lookup(spark, root, absent))
    assert len(absent) == 100 and len(read) == 3 and sum(read) == 0


def test_integer_ids(spark, home):
    store.write_version(spark.range(1000).selectExpr("id", "id * 2 as n"), home, buckets=4)
    found = store.lookup(spark, home, [3, 999, 5000])
    assert {(r["id"], r["n"]) for r in found.collect()} == {(3, 6), (999, 1998)}
