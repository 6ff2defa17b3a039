"""Queries on the source/target pair: windows, id sets, apply, journal, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsync.operators import apply, checks, diff, extract, journal
from docsync.operators.schema import remove_fields
from docsync.session import materialize
from queries import fixtures as fx
from queries.fixtures import pair_sql


def q_delta(spark, sf):
    return fx.changes(spark, sf)


def q_delta_inclusive(spark, sf):
    src = fx.source(spark, sf)
    first = extract.page(src, "ts", None, 40, since=fx.ntz(fx.CUTOVER))
    watermark = first.agg(F.max("ts").alias("w")).first()["w"]
    return extract.delta(src, "ts", fx.ntz(watermark), "gte")


def q_margin(spark, sf):
    bound = checks.lower_bound("2024-01-15T00:00:00+00:00", 21600).replace(tzinfo=None)
    events = fx.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return extract.delta(events, "ts", fx.ntz(bound))


def q_ids(spark, sf):
    return extract.live_ids(fx.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id"))


def q_sorted_ids(spark, sf):
    return extract.sorted_ids(fx.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id"))


def q_union_parts(spark, sf):
    return extract.union_parts([fx.source(spark, sf), fx.target(spark, sf), fx.changes(spark, sf)])


def q_lookup_found(spark, sf):
    found = extract.lookup(fx.target(spark, sf), fx.source(spark, sf))
    return found.select("id", "found", "doc.status", "doc.price", "doc.ts")


def q_change_kind(spark, sf):
    return extract.label_changes(fx.changes(spark, sf), fx.target(spark, sf)).select("id", "kind", "status")


def q_page(spark, sf):
    src = fx.source(spark, sf)
    first = extract.page(src, "ts", None, 40, since=fx.ntz(fx.CUTOVER))
    last = first.agg(F.max(F.struct("ts", "id")).alias("w")).first()["w"]
    return extract.page(src, "ts", (fx.ntz(last["ts"]), last["id"]), 100).select("id", "ts")


def q_to_delete(spark, sf):
    return diff.only_in(fx.after_delta(spark, sf), fx.source(spark, sf))


def q_to_repair(spark, sf):
    return diff.only_in(fx.source(spark, sf), fx.target(spark, sf))


def q_diff(spark, sf):
    return diff.diff(fx.source(spark, sf), fx.target(spark, sf))


def q_diff_counts(spark, sf):
    return q_diff(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_set_difference(spark, sf):
    return diff.set_difference(fx.target(spark, sf), fx.source(spark, sf))


def q_expected_set(spark, sf):
    return diff.expected_ids(fx.after_delta(spark, sf), fx.to_delete(spark, sf), fx.to_repair(spark, sf))


def q_set_equality(spark, sf):
    return diff.set_mismatch(fx.after_delta(spark, sf), fx.source(spark, sf))


def q_content_diff(spark, sf):
    return diff.content_diff(fx.source(spark, sf), fx.after_delta(spark, sf))


def _nested(df, stamped):
    inner = [F.col("cust").alias("cust"), F.col("prio").alias("prio")]
    if stamped:
        inner.append(F.col("ts").alias("modified"))
    doc = df.select("id", "status", "price", F.struct(*inner).alias("meta"))
    return doc.withColumn("modified_at", F.lit(1)) if stamped else doc


def q_content_diff_removed(spark, sf):
    ours = _nested(fx.source(spark, sf), True)
    theirs = _nested(fx.after_delta(spark, sf), False)
    return diff.content_diff(ours, theirs, "modified_at, meta.modified, nowhere.else")


def q_composite_key(spark, sf):
    """Conversations against a copy without assistant turns and with other user turns."""
    keys = ["conv_id", "turn"]
    src = fx.table(spark, sf, "conversations")
    tgt = src.where("role <> 'assistant'").withColumn(
        "text", F.when(F.col("turn") % 4 == 0, F.upper("text")).otherwise(F.col("text"))
    )
    return diff.diff(src, tgt, keys=keys)


def q_upsert(spark, sf):
    return fx.after_delta(spark, sf)


def q_delete(spark, sf):
    return apply.apply_deletes(fx.after_delta(spark, sf), fx.to_delete(spark, sf))


def q_repair(spark, sf):
    return apply.repair_rows(fx.source(spark, sf), fx.to_repair(spark, sf))


def q_latest(spark, sf):
    """Newest order per customer out of all copies of its id."""
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey", "o_orderstatus"
    )
    return apply.latest(rows, F.struct("o_orderdate", "o_orderkey"))


def q_merge_upsert(spark, sf):
    customers = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("info"),
    )
    patch = (
        fx.table(spark, sf, "orders")
        .groupBy((F.col("o_custkey") + 100).alias("id"))
        .agg(
            F.max("o_totalprice").alias("balance"),
            F.struct(F.min("o_orderpriority").alias("segment")).alias("info"),
        )
    )
    merged = apply.apply_merge(customers, patch)
    return merged.select("id", "name", "balance", "info.segment", "info.nation")


def full_journal(spark, sf):
    """Delta, deletes and repairs of one run, numbered through."""
    ids = fx.changes(spark, sf).select("id", F.lit("delta").alias("op"))
    more = fx.to_delete(spark, sf).select("id", F.lit("delete").alias("op"))
    repairs = fx.to_repair(spark, sf).select("id", F.lit("repair").alias("op"))
    numbered = journal.number(ids.unionByName(more).unionByName(repairs))
    # Written once, as a run does: every reader would compute it again otherwise.
    return materialize(journal.preimage(numbered, fx.target(spark, sf), F.col("op")), "journal")


def q_journal(spark, sf):
    return full_journal(spark, sf).select(
        "seq", "id", "op", "found",
        F.get_json_object("source", "$.status").alias("status"),
        F.get_json_object("source", "$.price").cast("double").alias("price"),
        F.get_json_object("source", "$.ts").cast("timestamp_ntz").alias("ts"),
        (F.col("source") == "{}").alias("empty"),
    )


def q_journal_audit(spark, sf):
    return journal.audit(full_journal(spark, sf))


def _replayed(spark, sf):
    """The journal of a run whose delta was applied twice: later rows are post-images."""
    ids = fx.changes(spark, sf).select("id")
    first = journal.preimage(journal.number(ids), fx.target(spark, sf), "delta")
    base = fx.table(spark, sf, "orders").count()
    again = journal.preimage(journal.number(ids, base), fx.after_delta(spark, sf), "delta")
    return first.unionByName(again)


def _image(df):
    return df.select("seq", "id", "op", "found", F.get_json_object("source", "$.status").alias("status"))


def q_first_image(spark, sf):
    return _image(journal.first_images(_replayed(spark, sf)))


def q_first_image_ranked(spark, sf):
    return _image(journal.first_images_ranked(_replayed(spark, sf)))


def q_undo(spark, sf):
    # The target is written when it is undone, as after a run.
    return journal.undo(materialize(fx.reconciled(spark, sf), "target"), full_journal(spark, sf))


def q_sample(spark, sf):
    return checks.sample(fx.source(spark, sf))


def q_verify(spark, sf):
    # What is verified is the written target.
    src, tgt = fx.source(spark, sf), materialize(fx.after_delta(spark, sf), "target")
    return checks.verify(
        src, tgt, before=tgt, to_delete=fx.to_delete(spark, sf), to_repair=fx.to_repair(spark, sf),
        sample_ids=checks.sample(src), full=True,
    )


def q_counts(spark, sf):
    sides = (("source", fx.source(spark, sf)), ("target", fx.target(spark, sf)), ("delta", fx.changes(spark, sf)))
    parts = [checks.counts(df).select(F.lit(name).alias("side"), "n") for name, df in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_high_water(spark, sf):
    none = fx.source(spark, sf).where("ts is null")
    sides = (("source", fx.source(spark, sf)), ("target", fx.target(spark, sf)), ("empty", none))
    parts = [checks.counts(df, "ts").select(F.lit(name).alias("side"), "high_water") for name, df in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_completeness(spark, sf):
    whole = checks.completeness(fx.source(spark, sf)).withColumn("side", F.lit("orders"))
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return whole.unionByName(checks.completeness(lines).withColumn("side", F.lit("lineitem")))


def q_bad_keys(spark, sf):
    n = F.col("event_id")
    ids = fx.table(spark, sf, "events").select(
        F.when(n % 3 == 0, None).when(n % 1001 == 1, "").when(n % 7 == 1, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .otherwise(n.cast("string")).alias("id")
    )
    return checks.bad_keys(ids)


def q_delete_ratio(spark, sf):
    marked = fx.to_delete(spark, sf).select(F.lit("d").alias("kind")).unionByName(
        fx.after_delta(spark, sf).select(F.lit("t").alias("kind"))
    )
    both = marked.agg(
        F.count_if(F.col("kind") == "d").alias("deletes"), F.count_if(F.col("kind") == "t").alias("target_rows")
    )
    return both.select(
        "deletes", "target_rows",
        checks.ratio_exceeded(F.col("deletes"), F.col("target_rows")).alias("over_default"),
        checks.ratio_exceeded(F.col("deletes"), F.col("target_rows"), 0.005).alias("over_half_percent"),
    )


def q_plan(spark, sf):
    size = F.octet_length("status") + F.octet_length("prio")
    return checks.plan(fx.source(spark, sf), fx.target(spark, sf), "ts", fx.ntz(fx.CUTOVER), size)


def q_freeze(spark, sf):
    """A source that stands still, one that gains rows, and one whose version alone moves."""
    still = checks.stable(lambda: fx.source(spark, sf), "ts")
    moving = iter([fx.target(spark, sf), fx.source(spark, sf)])
    version = iter([1, 2])
    return checks.counts(fx.source(spark, sf), "ts").withColumns({
        "stable": F.lit(still),
        "moving": F.lit(checks.stable(lambda: next(moving), "ts")),
        "rewritten": F.lit(checks.stable(lambda: fx.source(spark, sf), "ts", version_fn=lambda: next(version))),
    })


def q_remove_fields(spark, sf):
    doc = _nested(fx.source(spark, sf), True)
    left = remove_fields(doc, "modified_at, meta.prio,  meta.none, gone.a, price")
    return left.select("id", "status", "meta.cust", "meta.modified", F.lit(len(left.columns)).alias("width"))


QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if name.startswith("q_") and callable(fn)
}

_RUN_IDS = """ids AS (SELECT id, 'delta' AS op FROM chg UNION ALL SELECT id, 'delete' FROM del
  UNION ALL SELECT id, 'repair' FROM rep)"""

ORACLE = {
    "q_delta": pair_sql("SELECT * FROM chg"),
    "q_delta_inclusive": pair_sql(
        "SELECT * FROM src WHERE ts >= (SELECT max(ts) FROM (SELECT ts FROM chg ORDER BY ts, id LIMIT 40))"
    ),
    "q_margin": "SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 21600 SECOND",
    "q_ids": "SELECT DISTINCT l_orderkey AS id FROM lineitem",
    "q_sorted_ids": "SELECT DISTINCT l_orderkey AS id FROM lineitem ORDER BY id",
    "q_union_parts": pair_sql("SELECT id FROM src UNION SELECT id FROM tgt UNION SELECT id FROM chg"),
    "q_lookup_found": pair_sql(
        "SELECT s.id, t.id IS NOT NULL AS found, t.status, t.price, t.ts FROM src s LEFT JOIN tgt t ON s.id = t.id"
    ),
    "q_change_kind": pair_sql(
        "SELECT c.id, CASE WHEN t.id IS NULL THEN 'create' ELSE 'update' END AS kind, c.status FROM chg c LEFT JOIN tgt t ON c.id = t.id"
    ),
    "q_page": pair_sql(
        "SELECT id, ts FROM (SELECT id, ts, row_number() OVER (ORDER BY ts, id) AS r FROM chg) WHERE r BETWEEN 41 AND 140"
    ),
    "q_to_delete": pair_sql("SELECT id FROM del"),
    "q_to_repair": pair_sql("SELECT id FROM src EXCEPT SELECT id FROM tgt"),
    "q_diff": pair_sql(
        """SELECT coalesce(s.id, t.id) AS id,
           CASE WHEN t.id IS NULL THEN 'only_source' WHEN s.id IS NULL THEN 'only_target'
                WHEN s.cust = t.cust AND s.status = t.status AND s.price = t.price AND s.prio = t.prio AND s.ts = t.ts
                THEN 'same' ELSE 'changed' END AS status
           FROM src s FULL JOIN tgt t ON s.id = t.id"""
    ),
    "q_diff_counts": pair_sql(
        """SELECT CASE k WHEN 'create' THEN 'only_source' WHEN 'missed' THEN 'only_source'
                WHEN 'delete' THEN 'only_target' WHEN 'update' THEN 'changed' WHEN 'silent' THEN 'changed'
                ELSE 'same' END AS status, count(*) AS n FROM base GROUP BY 1"""
    ),
    "q_set_difference": pair_sql("SELECT id FROM tgt EXCEPT SELECT id FROM src"),
    "q_expected_set": pair_sql("SELECT id FROM src"),
    "q_set_equality": pair_sql("SELECT id, 'extra' AS side FROM del UNION ALL SELECT id, 'missing' FROM rep"),
    "q_content_diff": pair_sql("SELECT id FROM base WHERE k IN ('silent', 'missed')"),
    "q_content_diff_removed": pair_sql("SELECT id FROM base WHERE k IN ('silent', 'missed')"),
    "q_composite_key": """SELECT conv_id, turn,
        CASE WHEN role = 'assistant' THEN 'only_source' WHEN turn % 4 = 0 AND upper(text) <> text THEN 'changed'
             ELSE 'same' END AS status FROM conversations""",
    "q_upsert": pair_sql("SELECT * FROM aft"),
    "q_delete": pair_sql("SELECT * FROM aft WHERE id NOT IN (SELECT id FROM del)"),
    "q_repair": pair_sql("SELECT * FROM src WHERE id IN (SELECT id FROM rep)"),
    "q_latest": """SELECT id, o_orderdate, o_orderkey, o_orderstatus FROM (
        SELECT o_custkey AS id, o_orderdate, o_orderkey, o_orderstatus,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
        FROM orders) WHERE r = 1""",
    "q_merge_upsert": """WITH p AS (SELECT o_custkey + 100 AS id, max(o_totalprice) AS balance, min(o_orderpriority) AS segment
          FROM orders GROUP BY 1)
        SELECT coalesce(c.c_custkey, p.id) AS id, c.c_name AS name, coalesce(p.balance, c.c_acctbal) AS balance,
               coalesce(p.segment, c.c_mktsegment) AS segment, c.c_nationkey AS nation
        FROM customer c FULL JOIN p ON c.c_custkey = p.id""",
    "q_journal": pair_sql(
        f""", {_RUN_IDS} SELECT CAST(row_number() OVER (ORDER BY md5(CAST(i.id AS VARCHAR)), i.id) AS BIGINT) AS seq, i.id, i.op,
           CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS found, t.status, t.price, t.ts, t.id IS NULL AS empty
           FROM ids i LEFT JOIN tgt t ON i.id = t.id"""
    ),
    "q_journal_audit": pair_sql(
        """SELECT 'delta' AS op, CASE WHEN k = 'update' THEN 1 ELSE 0 END AS found, count(*) AS n
             FROM base WHERE k IN ('update', 'create') GROUP BY 2
           UNION ALL SELECT 'delete', 1, count(*) FROM base WHERE k = 'delete'
           UNION ALL SELECT 'repair', 0, count(*) FROM base WHERE k = 'missed'"""
    ),
    "q_undo": pair_sql("SELECT * FROM tgt"),
    "q_sample": pair_sql("SELECT id FROM src ORDER BY md5(id || '|42'), id LIMIT 1000"),
    "q_verify": pair_sql(
        """, smp AS (SELECT id FROM src ORDER BY md5(id || '|42'), id LIMIT 1000), r AS (
           SELECT 'count' AS "check", (SELECT count(*) FROM src) AS expected, (SELECT count(*) FROM aft) AS actual
           UNION ALL SELECT 'extra_ids', 0, (SELECT count(*) FROM del)
           UNION ALL SELECT 'missing_ids', 0, (SELECT count(*) FROM rep)
           UNION ALL SELECT 'expected_ids', 0, 0
           UNION ALL SELECT 'content_sample', 0, (SELECT count(*) FROM base JOIN smp USING (id) WHERE k IN ('silent', 'missed'))
           UNION ALL SELECT 'content_full', 0, (SELECT count(*) FROM base WHERE k IN ('silent', 'missed')))
           SELECT "check", expected, actual, expected = actual AS ok FROM r"""
    ),
    "q_counts": pair_sql(
        "SELECT 'source' AS side, count(*) AS n FROM src UNION ALL SELECT 'target', count(*) FROM tgt UNION ALL SELECT 'delta', count(*) FROM chg"
    ),
    "q_high_water": pair_sql(
        "SELECT 'source' AS side, max(ts) AS high_water FROM src UNION ALL SELECT 'target', max(ts) FROM tgt UNION ALL SELECT 'empty', NULL"
    ),
    "q_completeness": pair_sql(
        """SELECT count(*) AS counted, count(DISTINCT id) AS exported, true AS complete, 'orders' AS side FROM src
           UNION ALL SELECT count(*), count(DISTINCT l_orderkey), count(*) = count(DISTINCT l_orderkey), 'lineitem' FROM lineitem"""
    ),
    "q_bad_keys": """WITH i AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 1001 = 1 THEN ''
              WHEN event_id % 7 = 1 THEN 'u' || user_id ELSE CAST(event_id AS VARCHAR) END AS id FROM events)
        SELECT id, CASE WHEN id IS NULL THEN 'null' WHEN id = '' THEN 'empty' ELSE 'duplicate' END AS reason
        FROM i GROUP BY id HAVING id IS NULL OR id = '' OR count(*) > 1""",
    "q_delete_ratio": pair_sql(
        """, c AS (SELECT (SELECT count(*) FROM del) AS deletes, (SELECT count(*) FROM aft) AS target_rows)
           SELECT deletes, target_rows, deletes / target_rows > 0.10 AS over_default,
                  deletes / target_rows > 0.005 AS over_half_percent FROM c"""
    ),
    "q_plan": pair_sql(
        """, c AS (SELECT (SELECT count(*) FROM src) AS source_total, (SELECT count(*) FROM tgt) AS target_total,
             (SELECT count(*) FROM chg) AS delta, (SELECT CAST(sum(strlen(status) + strlen(prio)) AS DOUBLE) FROM tgt) AS bytes)
           SELECT source_total, target_total, delta, source_total - target_total AS net,
                  CAST(ceil(bytes / target_total * delta) AS BIGINT) AS journal_bytes FROM c"""
    ),
    "q_freeze": pair_sql("SELECT count(*) AS n, max(ts) AS high_water, true AS stable, (SELECT count(*) = (SELECT count(*) FROM src) FROM tgt) AS moving, false AS rewritten FROM src"),
    "q_remove_fields": pair_sql("SELECT id, status, cust, ts AS modified, 3 AS width FROM src"),
}
_FIRST = pair_sql(
    """SELECT CAST(row_number() OVER (ORDER BY md5(CAST(c.id AS VARCHAR)), c.id) AS BIGINT) AS seq, c.id, 'delta' AS op,
       CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS found, t.status FROM chg c LEFT JOIN tgt t ON c.id = t.id"""
)
ORACLE["q_first_image"] = _FIRST
ORACLE["q_first_image_ranked"] = _FIRST
