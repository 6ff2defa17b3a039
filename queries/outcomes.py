"""Queries on write results, dead letters and documents that do not fit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import to_document
from docsync.operators import checks, outcome
from docsync.operators.apply import apply_upserts
from queries import fixtures as fx
from queries.fixtures import items_sql, json_sql, pair_sql

K_INT = T.StructType([T.StructField("k", T.IntegerType())])
K_WIDE = T.StructType([T.StructField("k", T.StringType()), T.StructField("zzz", T.IntegerType())])


def _classified(spark, sf, final=False):
    paired = outcome.pair(outcome.explode_results(fx.results(spark, sf)), fx.submitted(spark, sf))
    return outcome.classify(paired, final)


def q_classify(spark, sf):
    return _classified(spark, sf).select(
        "batch", "ordinal", "_id", "op", "status", F.col("error.type").alias("type"), "source", "verdict"
    )


def q_tally(spark, sf):
    now = outcome.tally(_classified(spark, sf)).withColumn("attempt", F.lit("first"))
    last = outcome.tally(_classified(spark, sf, final=True)).withColumn("attempt", F.lit("last"))
    return now.unionByName(last)


def q_deadletters(spark, sf):
    dead = outcome.dead_letters(_classified(spark, sf, final=True), "delta")
    return dead.select(
        "_id", "tag", "status", F.col("error.type").alias("type"), F.col("error.reason").alias("reason"),
        "retry_exhausted", "action", "source",
    )


def q_deadletter_summary(spark, sf):
    """From JSON lines, with broken lines between them."""
    dead = outcome.dead_letters(_classified(spark, sf, final=True), "delta")
    lines = dead.select(F.to_json(F.struct("*")).alias("value"))
    broken = fx.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 2 == 0, '{"_id": "x", ').otherwise("no json").alias("value")
    )
    parsed = outcome.parse_dead_letters(lines.unionByName(broken))
    return outcome.summarise(parsed, 4)


def q_gate(spark, sf):
    per_batch = _classified(spark, sf).groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") != "retry").alias("seen"),
        F.count_if(F.col("verdict") == "fatal").alias("dead"),
    )
    no, yes = F.lit(False), F.lit(True)
    seen, total, dead = F.col("seen"), F.col("total"), F.col("dead")
    return per_batch.select(
        "batch", "seen", "total", "dead",
        checks.gate_passes(seen, total, dead, no).alias("as_is"),
        checks.gate_passes(total, total, dead, no).alias("all_seen"),
        checks.gate_passes(total, total, dead, yes).alias("allow_partial"),
        checks.gate_passes(total, total, F.lit(0), no).alias("clean"),
    )


def _conformed(spark, sf, strict):
    return outcome.conform(fx.documents_json(spark, sf), "json", K_INT, strict)


def q_conform(spark, sf):
    parts = []
    for strict in (False, True):
        ok, dead = _conformed(spark, sf, strict)
        mode = F.lit("strict" if strict else "open").alias("mode")
        parts.append(ok.select(mode, F.col("id").cast("string").alias("id"), "k", F.lit("ok").alias("outcome")))
        parts.append(dead.select(mode, F.col("_id").alias("id"), F.lit(None).cast("int").alias("k"), F.col("error.type").alias("outcome")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def q_reconform(spark, sf):
    """Dead letters under the strict narrow schema, tried again under a wider one."""
    _, dead = _conformed(spark, sf, True)
    ok, still = outcome.reconform(dead, K_WIDE, True)
    return ok.select("id", "k", F.lit("ok").alias("outcome")).unionByName(
        still.select(F.col("_id").alias("id"), F.lit(None).cast("string").alias("k"), F.col("error.type").alias("outcome"))
    )


def q_unresolved(spark, sf):
    """Every third change was rejected; creates among them come back by repair, updates do not."""
    src, chg, tgt = fx.source(spark, sf), fx.changes(spark, sf), fx.target(spark, sf)
    refused = F.col("id") % 3 == 0
    dead = chg.where(refused).select(F.col("id").cast("string").alias("_id"))
    applied = apply_upserts(tgt, chg.where(~refused))
    repaired = src.join(applied.select("id"), "id", "left_anti").where(F.col("id") % 2 == 0)
    current = applied.unionByName(repaired)
    doc = to_document(["cust", "status", "price", "prio", "ts"]).alias("doc")
    return outcome.unresolved(dead, src.select("id", doc), current.select("id", doc))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_") and callable(f)}

ORACLE = {
    "q_classify": items_sql("SELECT batch, ordinal, _id, op, status, type, source, verdict FROM items"),
    "q_tally": items_sql(
        """SELECT count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'retry') AS retry,
             count(*) FILTER (verdict = 'fatal') AS fatal, 0 AS exhausted, 'first' AS attempt FROM items
           UNION ALL SELECT count(*) FILTER (verdict = 'ok'), 0, count(*) FILTER (verdict = 'fatal'),
             count(*) FILTER (verdict = 'retry'), 'last' FROM items"""
    ),
    "q_deadletters": items_sql(
        """SELECT _id, 'delta' AS tag, status, type, 'refused ' || chr(10) || ' by  ' || type AS reason,
             verdict = 'retry' AS retry_exhausted, op AS action, source FROM items WHERE verdict <> 'ok'"""
    ),
    "q_deadletter_summary": items_sql(
        """SELECT 'delta' AS tag, CAST(status AS VARCHAR) AS status, coalesce(type, '-') AS type, count(*) AS n,
             coalesce('refused by ' || type, '') AS reason
           FROM items WHERE verdict <> 'ok' GROUP BY status, type
           ORDER BY n DESC, tag, status, type LIMIT 4"""
    ),
    "q_gate": items_sql(
        """, g AS (SELECT batch, count(*) FILTER (verdict <> 'retry') AS seen, count(*) AS total,
               count(*) FILTER (verdict = 'fatal') AS dead FROM items GROUP BY batch)
           SELECT batch, seen, total, dead, seen >= total AND dead = 0 AS as_is, dead = 0 AS all_seen,
                  true AS allow_partial, true AS clean FROM g"""
    ),
    "q_conform": json_sql(
        """SELECT 'open' AS mode, CAST(id AS VARCHAR) AS id, CASE WHEN kind IN ('ok', 'extra') THEN k END AS k,
             CASE WHEN kind IN ('ok', 'extra') THEN 'ok' ELSE 'mapper_parsing_exception' END AS outcome FROM docs
           UNION ALL SELECT 'strict', CAST(id AS VARCHAR), CASE WHEN kind = 'ok' THEN k END,
             CASE kind WHEN 'ok' THEN 'ok' WHEN 'extra' THEN 'strict_dynamic_mapping_exception'
                  ELSE 'mapper_parsing_exception' END FROM docs"""
    ),
    "q_reconform": json_sql(
        """SELECT CAST(id AS VARCHAR) AS id, CASE kind WHEN 'bad' THEN 'bad' WHEN 'extra' THEN CAST(k AS VARCHAR) END AS k,
             CASE WHEN kind = 'broken' THEN 'mapper_parsing_exception' ELSE 'ok' END AS outcome
           FROM docs WHERE kind <> 'ok'"""
    ),
    "q_unresolved": pair_sql(
        """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN k = 'update' THEN 'stale' WHEN id % 2 = 0 THEN 'recovered'
             ELSE 'absent' END AS state FROM base WHERE k IN ('create', 'update') AND id % 3 = 0"""
    ),
}
