"""Whole jobs on versioned tables below the shared folder; each query starts from fresh tables."""

from __future__ import annotations

import datetime as dt
from unittest import mock

from pyspark.sql import functions as F

from docsync.operators.checks import GateFailed
from docsync.operators.outcome import DEAD_LETTER
from docsync.plans import jobs
from docsync.session import fresh_dir
from docsync.sources import digest, store
from docsync.sources.journal_store import read_journal
from docsync.streaming.sync import sync_once
from queries import fixtures as fx
from queries.fixtures import pair_sql

SINCE = "2001-01-01T00:00:00+00:00"


def _config(spark, sf, home, table="orders", source=None, **settings):
    """The fixture's target as a stored table, its source, and a run between them."""
    root = f"{home}/{table}"
    store.write_version(fx.target(spark, sf), root)

    def orders(session):
        return fx.source(session, sf)

    # The silent updates of the fixture would fail the content sample, as they should (see
    # q_verify); here the run itself is looked at.
    settings = {"since": SINCE, "ts_field": "ts", "margin": 0, "sample_rows": 0, "freeze_wait": 0, **settings}
    return jobs.SyncConfig(table=table, source=source or orders, target=root, home=f"{home}/runs", **settings)


def q_full_copy(spark, sf):
    root = fresh_dir(spark, "copy")
    jobs.copy_table(fx.source(spark, sf), root)
    return store.read_table(spark, root)


def q_copy_totals(spark, sf):
    """A first copy, then a copy of the changed table over it."""
    root = fresh_dir(spark, "copy")
    jobs.copy_table(fx.target(spark, sf), root)
    return jobs.copy_table(fx.source(spark, sf), root)


def q_marker(spark, sf):
    """The newest order date as the cutover marker, set twice; the later value counts."""
    root = fresh_dir(spark, "marker")
    high = fx.source(spark, sf).agg(F.max("ts")).first()[0]
    for moment in (fx.CUTOVER, high):
        store.set_marker(spark, root, "cutover_at", moment.strftime("%Y-%m-%dT%H:%M:%SZ"))
    found = store.get_marker(spark, root, "cutover_at")
    given = store.get_marker(spark, root, "other", override=SINCE)
    return store.markers(spark, root).withColumns({"read": F.lit(found), "override": F.lit(given)})


def q_run(spark, sf):
    cfg = _config(spark, sf, fresh_dir(spark, "run"))
    jobs.run(spark, cfg)
    return store.read_table(spark, cfg.target)


def q_run_counters(spark, sf):
    cfg = _config(spark, sf, fresh_dir(spark, "run"))
    jobs.run(spark, cfg)
    return jobs.state_table(spark, cfg.home).select(
        "table", "phase", "total", "seen", "synced", "dl_count", "deleted_planned", "deleted_applied",
        "repaired_planned", "repaired_applied", "journal_seq", "outcome",
    )


def _must_fail(kind, fn, *args):
    """Runs what has to raise ``kind``."""
    try:
        fn(*args)
    except kind:
        return
    raise AssertionError(f"{fn.__name__} did not stop")


def q_resume(spark, sf):
    """Stopped by the delete guard, then resumed with consent."""
    home = fresh_dir(spark, "resume")
    cfg = _config(spark, sf, home, max_delete_ratio=0.0)
    _must_fail(GateFailed, jobs.run, spark, cfg)
    jobs.resume(spark, jobs.SyncConfig(**{**cfg.__dict__, "assume_yes": True}))
    return store.read_table(spark, cfg.target)


def _crash_then_resume(spark, sf, label):
    """A run that dies just before its first commit; meanwhile the source gains updates."""
    cfg = _config(spark, sf, fresh_dir(spark, label))
    with mock.patch.object(store, "commit_changes", side_effect=OSError("lost")):
        _must_fail(OSError, jobs.run, spark, cfg)

    def orders(session):
        rows = fx.source(session, sf)
        late = F.col("id") % 13 == 0
        moved = F.when(late, fx.ntz(dt.datetime(2002, 1, 1))).otherwise(F.col("ts"))
        return rows.withColumn("price", F.when(late, 0.0).otherwise(F.col("price"))).withColumn("ts", moved)

    cfg = jobs.SyncConfig(**{**cfg.__dict__, "source": orders})
    jobs.resume(spark, cfg)
    return cfg


def q_resume_crash(spark, sf):
    """Crash, changed source, resume, undo: the target as it was, row for row."""
    cfg = _crash_then_resume(spark, sf, "crash")
    jobs.undo(spark, cfg)
    return store.read_table(spark, cfg.target)


def q_resume_crash_counters(spark, sf):
    """The resumed run holds what the crashed one had staged, and counts it once."""
    cfg = _crash_then_resume(spark, sf, "crash")
    state = jobs.load_state(spark, cfg)
    journal = read_journal(spark, cfg.journal, state.run_id)
    return journal.agg(
        F.count(F.lit(1)).alias("journaled"), F.countDistinct("seq").alias("numbers"), F.max("seq").alias("last"),
        F.count_if(F.col("op") == "delta").alias("deltas"),
    ).select(F.lit(state.journal_seq).cast("long").alias("counted"), "*")


def q_verify_run(spark, sf):
    """A whole run with full comparison: it fails, and names the rows that changed silently."""
    cfg = _config(spark, sf, fresh_dir(spark, "verify"), full_compare=True)
    _must_fail(GateFailed, jobs.run, spark, cfg)
    return spark.read.parquet(jobs.load_state(spark, cfg).offending)


def q_verify_run_types(spark, sf):
    """A source in other types with one more column: verified, and the column kept."""
    home = fresh_dir(spark, "types")
    cfg = _config(spark, sf, home, full_compare=True, sample_rows=50)

    def orders(session):
        rows = fx.source(session, sf)
        return rows.withColumn("cust", F.col("cust").cast("string")).withColumn("note", F.lit("n"))

    cfg = jobs.SyncConfig(**{**cfg.__dict__, "source": orders, "ts_field": None})
    state = jobs.run(spark, cfg)
    rows = store.read_table(spark, cfg.target)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("notes"), F.sum("cust").alias("cust")).withColumn("outcome", F.lit(state.outcome))


def q_copy_rejects(spark, sf):
    """A copy with rows that do not fit: the old version stays, the dead letters are complete."""
    root = fresh_dir(spark, "rejects")
    jobs.copy_table(fx.target(spark, sf), root)
    bad = fx.source(spark, sf).withColumn(
        "cust", F.when(F.col("id") % 3 == 0, F.lit("n/a")).otherwise(F.col("cust").cast("string"))
    )
    totals = jobs.copy_table(bad, root, fx.target(spark, sf).schema)
    dead = spark.read.schema(DEAD_LETTER).json(f"{root}/_dead/*").agg(F.countDistinct("_id").alias("dead"))
    return totals.withColumn("dead", F.lit(dead.first()[0]).cast("long"))


def q_undo_run(spark, sf):
    cfg = _config(spark, sf, fresh_dir(spark, "undo"))
    jobs.run(spark, cfg)
    jobs.undo(spark, cfg)
    return store.read_table(spark, cfg.target)


def _later(spark, sf, cfg):
    """The same run over a source that gained updates since."""

    def orders(session):
        rows = fx.source(session, sf)
        late = F.col("id") % 13 == 0
        moved = F.when(late, fx.ntz(dt.datetime(2002, 1, 1))).otherwise(F.col("ts"))
        return rows.withColumn("price", F.when(late, 0.0).otherwise(F.col("price"))).withColumn("ts", moved)

    return jobs.SyncConfig(**{**cfg.__dict__, "source": orders})


def q_undo_twice(spark, sf):
    """Two runs, undone one after the other."""
    cfg = _config(spark, sf, fresh_dir(spark, "undo"))
    jobs.run(spark, cfg)
    jobs.run(spark, _later(spark, sf, cfg))
    jobs.undo(spark, cfg)
    jobs.undo(spark, cfg)
    return store.read_table(spark, cfg.target)


def q_undo_abandoned(spark, sf):
    """A good run, then one that dies before it changes anything and is given up: the good one is undone."""
    cfg = _config(spark, sf, fresh_dir(spark, "undo"))
    jobs.run(spark, cfg)
    with mock.patch.object(store, "commit_changes", side_effect=OSError("lost")):
        _must_fail(OSError, jobs.run, spark, _later(spark, sf, cfg))
    jobs.abandon(spark, cfg)
    jobs.undo(spark, cfg)
    return store.read_table(spark, cfg.target)


def q_undo_schema(spark, sf):
    """A run that adds a column, undone: rows and columns as they were."""
    cfg = _config(spark, sf, fresh_dir(spark, "undo"))

    def orders(session):
        return fx.source(session, sf).withColumn("note", F.lit("n"))

    jobs.run(spark, jobs.SyncConfig(**{**cfg.__dict__, "source": orders}))
    jobs.undo(spark, cfg)
    return store.read_table(spark, cfg.target)


def _changed_table(spark, sf):
    """A stored table with a change set of updates and inserts, one of deletes, and one that takes back some."""
    root = f"{fresh_dir(spark, 'feed')}/orders"
    store.write_version(fx.target(spark, sf), root)
    schema = store.schema_of(store.read_commit(spark, root))
    changes, gone = fx.changes(spark, sf), fx.to_delete(spark, sf)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "id"]
    back = fx.target(spark, sf).join(gone.where("id % 2 = 0"), "id", "left_semi")
    for rows, op in ((changes, "index"), (gone.select("id", *blank), "delete"), (back, "index")):
        store.commit_changes(spark, root, store.stage_changes(rows.withColumn("op", F.lit(op)), root))
    return root


def q_changes_between(spark, sf):
    """What became of each id since the first version, from the change sets alone."""
    return store.changes_between(spark, _changed_table(spark, sf), 1, kinds=True)


def q_run_feed(spark, sf):
    """A run, changes of the versioned source that no timestamp tells, and a run that continues by the change feed."""
    source = _changed_table(spark, sf)
    cfg = _config(spark, sf, fresh_dir(spark, "feed"), source=source, ts_field=None, since="last")
    jobs.run(spark, cfg)
    silent = store.read_table(spark, source).where("id % 7 = 0").withColumn("status", F.lit("Z"))
    store.commit_changes(spark, source, store.stage_changes(silent.withColumn("op", F.lit("index")), source))
    state = jobs.run(spark, cfg)
    rows = store.read_table(spark, cfg.target)
    return rows.withColumn("applied", F.lit(state.synced).cast("long"))


def q_lookup_ids(spark, sf):
    """The hundred dearest orders by id in a stored table with change sets; ids that it lacks give no row."""
    top = fx.classes(spark, sf).orderBy(F.desc("price"), "id").limit(100)
    return store.lookup(spark, _changed_table(spark, sf), [r["id"] for r in top.select("id").collect()])


def _copies(spark, sf):
    """Source and target of the fixture as stored tables of different numbers of buckets."""
    roots = []
    for rows, buckets in ((fx.source, 12), (fx.target, 8)):
        roots.append(fresh_dir(spark, "digest"))
        store.write_version(rows(spark, sf), roots[-1], buckets=buckets)
    return roots


def q_digest_compare(spark, sf):
    """What differs between two stored tables, from their digests and prints."""
    return digest.compare(spark, *_copies(spark, sf))


def q_digest_layers(spark, sf):
    """The same after the target got the source's delta as a change set and lost what the source lacks."""
    source, target = _copies(spark, sf)
    digest.keep(spark, target)
    fresh = fx.changes(spark, sf).withColumn("op", F.lit("index"))
    gone = store.read_table(spark, target).join(fx.to_delete(spark, sf), "id", "left_semi").withColumn("op", F.lit("delete"))
    for changes in (fresh, gone):
        store.commit_changes(spark, target, store.stage_changes(changes, target))
    return digest.compare(spark, source, target)


def q_digest_ranges(spark, sf):
    """Rows counted by the digest in its own buckets and rolled up to fewer, and rows that differ from itself."""
    root = _copies(spark, sf)[0]
    ranges, fewer = digest.ranges_of(spark, root), digest.ranges_of(spark, root, buckets=3)
    both = ranges.select("n", F.lit(0).alias("m")).unionByName(fewer.select(F.lit(0).alias("n"), F.col("n").alias("m")))
    left = digest.compare(spark, root, root).count()
    return both.agg(F.sum("n").alias("rows"), F.sum("m").alias("rolled")).withColumn("differing", F.lit(left).cast("long"))


def q_verify_digest(spark, sf):
    """A run between stored tables, fully compared by digests: it fails, and names the rows that changed silently."""
    source = _copies(spark, sf)[0]
    cfg = _config(spark, sf, fresh_dir(spark, "verify"), source=source, full_compare=True, digests=True)
    _must_fail(GateFailed, jobs.run, spark, cfg)
    return spark.read.parquet(jobs.load_state(spark, cfg).offending)


def q_run_last(spark, sf):
    """A run, later updates, and a run from the watermark of the first on; rows at the watermark come once."""
    cfg = _config(spark, sf, fresh_dir(spark, "last"))
    jobs.run(spark, cfg)
    later = _later(spark, sf, cfg)
    state = jobs.run(spark, jobs.SyncConfig(**{**later.__dict__, "since": "last", "source": _named(later.source)}))
    return store.read_table(spark, cfg.target).withColumn("applied", F.lit(state.synced).cast("long"))


def _named(source):
    """The function under the name that the first run knows its source by."""
    source.__name__ = "orders"
    return source


def q_versions(spark, sf):
    """Row counts of every version of a table that a run has changed."""
    cfg = _config(spark, sf, fresh_dir(spark, "versions"))
    jobs.run(spark, cfg)
    parts = [
        store.read_table(spark, cfg.target, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
        for v in store.versions(spark, cfg.target)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def q_summary(spark, sf):
    """A good table, one with a cutover in the future, one interrupted, and one never reached."""
    home = fresh_dir(spark, "many")
    good = _config(spark, sf, home)
    bad = _config(spark, sf, home, table="orders_late", since="2999-01-01T00:00:00+00:00")

    def interrupted(session):
        raise KeyboardInterrupt

    stopped = jobs.SyncConfig(**{**good.__dict__, "table": "orders_stopped", "source": interrupted})
    unreached = jobs.SyncConfig(**{**good.__dict__, "table": "orders_unreached"})
    return jobs.run_many(spark, [bad, good, stopped, unreached])


def q_worst(spark, sf):
    """Severity over many results: one per event type and day."""
    events = fx.table(spark, sf, "events")
    n = F.col("event_id") % 10
    states = events.select(
        "event_type",
        F.when(n == 0, "dead_letters").when((n == 1) & (F.col("event_type") != "view"), "interrupted").otherwise("ok").alias("outcome"),
    )
    return states.groupBy("event_type").agg(
        F.max_by("outcome", jobs.severity(F.col("outcome"))).alias("outcome"),
        F.max(jobs.severity(F.col("outcome"))).alias("severity"),
    )


def q_rates(spark, sf):
    """Rates of imagined runs: one per event type, its rows over the time they span."""
    states = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("table")).agg(
        F.lit("r").alias("run_id"),
        F.count(F.lit(1)).alias("synced"),
        (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).cast("double").alias("seconds"),
    )
    out = jobs.rates(states)
    return out.select("table", "synced", "seconds", F.round("rows_per_sec", 6).alias("rows_per_sec"), F.round("ms_per_row", 3).alias("ms_per_row"))


def q_stream_once(spark, sf):
    """Changes arrive as files, some ids twice and the older one last; a second pass finds nothing new."""
    home = fresh_dir(spark, "stream")
    root = f"{home}/orders"
    store.write_version(fx.target(spark, sf), root)
    changes = fx.changes(spark, sf)
    changes.repartition(3, "id").write.parquet(f"{home}/in")
    # Superseded versions of every other change, in files of a later time.
    older = changes.where("id % 2 = 0").withColumn("status", F.lit("O")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    args = (spark, f"{home}/in", changes.schema, root, f"{home}/checkpoint", f"{home}/journal", f"{home}/dead", "ts")
    sync_once(*args, files_per_batch=1)
    older.write.mode("append").parquet(f"{home}/in")
    first = sync_once(*args, files_per_batch=2)
    second = sync_once(*args, files_per_batch=1)
    if first != second:
        raise AssertionError("the second pass changed the table")
    return store.read_table(spark, root)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_") and callable(f)}

_FINAL = pair_sql("SELECT id, cust, status, price, prio, ts FROM base WHERE k <> 'delete'")
_COUNTS = """, c AS (SELECT count(*) FILTER (k IN ('create', 'update')) AS d, count(*) FILTER (k = 'delete') AS x,
    count(*) FILTER (k = 'missed') AS m, count(*) FILTER (k = 'create') AS cr FROM base)"""

_FEED = """, new AS (SELECT id, cust, status, price, prio, ts FROM base WHERE k IN ('create', 'update')),
    gone AS (SELECT id FROM base WHERE k = 'delete')"""

ORACLE = {
    "q_full_copy": pair_sql("SELECT * FROM src"),
    "q_copy_totals": pair_sql(
        """SELECT count(*) AS source_rows, count(*) - count(t.id) AS created, count(t.id) AS updated,
             0 AS failed, count(*) AS target_rows, true AS ok FROM src s LEFT JOIN tgt t ON s.id = t.id"""
    ),
    "q_marker": pair_sql(
        """SELECT 'cutover_at' AS key, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS value,
             strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS read, '2001-01-01T00:00:00+00:00' AS override FROM src"""
    ),
    "q_run": _FINAL,
    "q_resume": _FINAL,
    "q_resume_crash": pair_sql("SELECT * FROM tgt"),
    "q_resume_crash_counters": pair_sql(_COUNTS + " SELECT d + x + m AS counted, d + x + m AS journaled, d + x + m AS numbers, d + x + m AS last, d AS deltas FROM c"),
    "q_verify_run": pair_sql("""SELECT 'content_full' AS "check", CAST(id AS VARCHAR) AS id FROM base WHERE k = 'silent'"""),
    "q_verify_digest": pair_sql("""SELECT 'content_full' AS "check", CAST(id AS VARCHAR) AS id FROM base WHERE k = 'silent'"""),
    "q_digest_compare": pair_sql("""SELECT id, CASE WHEN k IN ('create', 'missed') THEN 'only_source' WHEN k = 'delete' THEN 'only_target'
             ELSE 'changed' END AS status FROM base WHERE k <> 'same'"""),
    "q_digest_layers": pair_sql("""SELECT id, CASE k WHEN 'missed' THEN 'only_source' ELSE 'changed' END AS status FROM base
           WHERE k IN ('missed', 'silent')"""),
    "q_digest_ranges": pair_sql("SELECT count(*) AS rows, count(*) AS rolled, 0 AS differing FROM src"),
    "q_verify_run_types": pair_sql("SELECT count(*) AS n, count(*) AS notes, CAST(sum(cust) AS BIGINT) AS cust, 'ok' AS outcome FROM src"),
    "q_copy_rejects": pair_sql(
        """SELECT count(*) AS source_rows, 0 AS created, 0 AS updated, count(*) FILTER (id % 3 = 0) AS failed,
             (SELECT count(*) FROM tgt) AS target_rows, false AS ok, count(*) FILTER (id % 3 = 0) AS dead FROM src"""
    ),
    "q_run_counters": pair_sql(
        _COUNTS + """ SELECT 'orders' AS "table", 'DONE' AS phase, d AS total, d AS seen, d AS synced, 0 AS dl_count,
           x AS deleted_planned, x AS deleted_applied, m AS repaired_planned, m AS repaired_applied,
           d + x + m AS journal_seq, 'ok' AS outcome FROM c"""
    ),
    "q_undo_run": pair_sql("SELECT * FROM tgt"),
    "q_undo_twice": pair_sql("SELECT * FROM tgt"),
    "q_undo_abandoned": pair_sql("SELECT * FROM tgt"),
    "q_undo_schema": pair_sql("SELECT * FROM tgt"),
    "q_changes_between": pair_sql(_FEED + """ SELECT 'delete' AS change, id, NULL AS cust, NULL AS status, NULL AS price, NULL AS prio, NULL AS ts
           FROM gone WHERE id % 2 <> 0
         UNION ALL SELECT CASE WHEN t.id IS NULL THEN 'insert' ELSE 'update' END, n.* FROM new n LEFT JOIN tgt t ON n.id = t.id
         UNION ALL SELECT 'update', t.* FROM tgt t WHERE id IN (SELECT id FROM gone WHERE id % 2 = 0)"""),
    "q_lookup_ids": pair_sql(_FEED + """, v AS (
           SELECT * FROM tgt WHERE id NOT IN (SELECT id FROM new) AND id NOT IN (SELECT id FROM gone WHERE id % 2 <> 0)
           UNION ALL SELECT * FROM new)
         SELECT v.* FROM v WHERE id IN (SELECT id FROM base ORDER BY price DESC, id LIMIT 100)"""),
    "q_run_feed": pair_sql(_FEED + """, v AS (
           SELECT * FROM tgt WHERE id NOT IN (SELECT id FROM new) AND id NOT IN (SELECT id FROM gone WHERE id % 2 <> 0)
           UNION ALL SELECT * FROM new)
         SELECT id, cust, CASE WHEN id % 7 = 0 THEN 'Z' ELSE status END AS status, price, prio, ts,
           count(*) FILTER (id % 7 = 0 AND status <> 'Z') OVER () AS applied FROM v"""),
    "q_run_last": pair_sql("""SELECT a.id, cust, status, CASE WHEN a.id % 13 = 0 THEN 0.0 ELSE price END AS price, prio,
           CASE WHEN a.id % 13 = 0 THEN TIMESTAMP '2002-01-01' ELSE ts END AS ts,
           (SELECT count(*) FROM src WHERE id % 13 = 0) AS applied
         FROM (SELECT * FROM base WHERE k <> 'delete' AND id % 13 <> 0 UNION ALL BY NAME SELECT * FROM src WHERE id % 13 = 0) a"""),
    "q_versions": pair_sql(
        """SELECT 1 AS version, count(*) AS n FROM tgt UNION ALL SELECT 2, count(*) FROM aft
           UNION ALL SELECT 3, count(*) FROM src"""
    ),
    "q_summary": pair_sql(
        _COUNTS + """ SELECT 'orders' AS "table", 'DONE' AS phase, d AS seen, d AS synced, x AS deleted, m AS repaired,
           0 AS dead_letters, 'ok' AS outcome FROM c
           UNION ALL SELECT 'orders_late', 'DONE', 0, 0, 0, 0, 0, 'failed'
           UNION ALL SELECT t, NULL, NULL, NULL, NULL, NULL, NULL, 'interrupted' FROM (SELECT unnest(['orders_stopped', 'orders_unreached']) AS t)"""
    ),
    "q_worst": """SELECT event_type, CASE max(s) WHEN 2 THEN 'interrupted' WHEN 1 THEN 'dead_letters' ELSE 'ok' END AS outcome,
          max(s) AS severity
        FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 = 1 AND event_type <> 'view' THEN 2 ELSE 0 END AS s
              FROM events) GROUP BY event_type""",
    "q_rates": """WITH r AS (SELECT event_type AS "table", count(*) AS synced,
            CAST(floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) AS DOUBLE) AS seconds FROM events GROUP BY 1)
        SELECT "table", synced, seconds, round(synced / seconds, 6) AS rows_per_sec, round(seconds * 1000 / synced, 3) AS ms_per_row FROM r""",
    "q_stream_once": pair_sql("SELECT * FROM aft"),
}
