"""Inputs of the registered queries, derived from the given tables.

``orders`` gives a source and a target table that differ in known ways, ``events`` gives write
results and JSON documents. All rows of a table take part.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.operators.apply import apply_deletes, apply_upserts
from docsync.operators.diff import only_in
from docsync.operators.extract import delta
from docsync.session import materialize, spread, tune

CUTOVER = dt.datetime(2001, 1, 1)
OLD = dt.datetime(1994, 12, 31)
COLUMNS = ["id", "cust", "status", "price", "prio", "ts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(moment: dt.datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.col("ts") > ntz(CUTOVER)
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("cust"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderpriority").alias("prio"),
            F.col("o_orderdate").alias("ts"),
        )
        .withColumn(
            "k",
            F.when(after & (F.col("id") % 5 == 0), "create")
            .when(after, "update")
            .when(F.col("id") % 97 == 0, "delete")
            .when(F.col("id") % 211 == 0, "missed")
            .when(F.col("id") % 499 == 7, "silent")
            .otherwise("same"),
        )
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(spark, sf_dir).where("k <> 'delete'")
    status = F.when(F.col("k") == "silent", "S").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*COLUMNS)


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classes(spark, sf_dir).where("k not in ('create', 'missed')")
    old = F.col("k") == "update"
    return (
        rows.withColumn("status", F.when(old, "X").otherwise(F.col("status")))
        .withColumn("price", F.when(old, F.col("price") - 1.0).otherwise(F.col("price")))
        .withColumn("ts", F.when(old, ntz(OLD)).otherwise(F.col("ts")))
        .select(*COLUMNS)
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta(source(spark, sf_dir), "ts", ntz(CUTOVER))


def after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_upserts(target(spark, sf_dir), changes(spark, sf_dir))


def after_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the target after the delta, without touching its documents."""
    return target(spark, sf_dir).select("id").union(changes(spark, sf_dir).select("id")).distinct()


# Both are staged, as in a run: a plan over several of them would hold a hash table of each join in every task.
def to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(only_in(after_ids(spark, sf_dir), source(spark, sf_dir)), "to-delete")


def to_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(only_in(source(spark, sf_dir), after_ids(spark, sf_dir)), "to-repair")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_deletes(after_delta(spark, sf_dir), to_delete(spark, sf_dir))
    src = source(spark, sf_dir)
    return apply_upserts(kept, src.join(to_repair(spark, sf_dir), "id", "left_semi"))


# ---- write results -------------------------------------------------------------------------


def result_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch, ordinal, op, status, type`` of every event's simulated write."""
    kind = F.col("event_id") % 20
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.col("event_id") / 100).cast("bigint").alias("batch"),
        (F.col("event_id") % 100).cast("int").alias("ordinal"),
        F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("_id"),
        F.when(kind == 2, "delete").otherwise("index").alias("op"),
        F.when(kind == 0, 429).when(kind == 1, 400).when(kind == 2, 404).when(kind == 3, 503)
        .when(kind == 4, 403).when(kind == 5, 404).otherwise(200).alias("status"),
        F.when(kind == 1, "mapper_parsing_exception").when(kind == 4, "cluster_block_exception")
        .alias("type"),
        "props",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses: per batch (100 writes) an array of single-entry maps, in order."""
    failed = F.when(
        F.col("type").isNotNull(),
        F.struct("type", F.concat(F.lit("refused \n by  "), F.col("type")).alias("reason")),
    )
    body = F.struct("_id", "status", failed.alias("error"))
    entry = F.struct("ordinal", "op", body.alias("body"))
    grouped = result_items(spark, sf_dir).groupBy("batch").agg(
        F.sort_array(F.collect_list(entry)).alias("rows")
    )
    return grouped.select(
        "batch", F.transform("rows", lambda r: F.create_map(r["op"], r["body"])).alias("items")
    )


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_items(spark, sf_dir).select(
        "batch",
        "ordinal",
        F.col("op").alias("action"),
        F.when(F.col("op") != "delete", F.col("props")).alias("source"),
    )


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, json``: event documents, some of them not fitting ``k int``."""
    n = F.col("event_id")
    return spread(table(spark, sf_dir, "events").select("event_id", "props")).select(
        n.alias("id"),
        F.when(n % 37 == 0, F.lit('{"k": "bad"}'))
        .when(n % 41 == 0, F.regexp_replace("props", r"\}$", ', "zzz": 1}'))
        .when(n % 101 == 0, F.lit('{"k": '))
        .otherwise(F.col("props"))
        .alias("json"),
    )


# ---- the same inputs for the oracle -------------------------------------------------------------

PAIR_SQL = """
base AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price,
         o_orderpriority AS prio, o_orderdate AS ts,
         CASE WHEN o_orderdate > TIMESTAMP '2001-01-01 00:00:00' AND o_orderkey % 5 = 0 THEN 'create'
              WHEN o_orderdate > TIMESTAMP '2001-01-01 00:00:00' THEN 'update'
              WHEN o_orderkey % 97 = 0 THEN 'delete'
              WHEN o_orderkey % 211 = 0 THEN 'missed'
              WHEN o_orderkey % 499 = 7 THEN 'silent'
              ELSE 'same' END AS k
  FROM orders),
src AS (
  SELECT id, cust, CASE WHEN k = 'silent' THEN 'S' ELSE status END AS status, price, prio, ts
  FROM base WHERE k <> 'delete'),
tgt AS (
  SELECT id, cust, CASE WHEN k = 'update' THEN 'X' ELSE status END AS status,
         CASE WHEN k = 'update' THEN price - 1.0 ELSE price END AS price, prio,
         CASE WHEN k = 'update' THEN TIMESTAMP '1994-12-31 00:00:00' ELSE ts END AS ts
  FROM base WHERE k NOT IN ('create', 'missed')),
chg AS (SELECT * FROM src WHERE ts > TIMESTAMP '2001-01-01 00:00:00'),
aft AS (SELECT * FROM tgt WHERE id NOT IN (SELECT id FROM chg) UNION ALL SELECT * FROM chg),
del AS (SELECT id FROM aft EXCEPT SELECT id FROM src),
rep AS (SELECT id FROM src EXCEPT SELECT id FROM aft),
fin AS (
  SELECT id, cust, status, price, prio, ts FROM base WHERE k NOT IN ('delete'))
"""

ITEMS_SQL = """
items AS (
  SELECT event_id, event_id // 100 AS batch, CAST(event_id % 100 AS INTEGER) AS ordinal,
         'doc-' || event_id AS _id,
         CASE WHEN event_id % 20 = 2 THEN 'delete' ELSE 'index' END AS op,
         CASE event_id % 20 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 404 WHEN 3 THEN 503
              WHEN 4 THEN 403 WHEN 5 THEN 404 ELSE 200 END AS status,
         CASE event_id % 20 WHEN 1 THEN 'mapper_parsing_exception'
              WHEN 4 THEN 'cluster_block_exception' END AS type,
         CASE WHEN event_id % 20 = 2 THEN NULL ELSE props END AS source,
         CASE WHEN event_id % 20 IN (0, 3, 4) THEN 'retry' WHEN event_id % 20 IN (1, 5) THEN 'fatal'
              ELSE 'ok' END AS verdict
  FROM events)
"""

JSON_SQL = """
docs AS (
  SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN event_id % 37 = 0 THEN 'bad' WHEN event_id % 41 = 0 THEN 'extra'
              WHEN event_id % 101 = 0 THEN 'broken' ELSE 'ok' END AS kind,
         CASE WHEN event_id % 37 = 0 THEN '{"k": "bad"}'
              WHEN event_id % 41 = 0 THEN regexp_replace(props, '\\}$', ', "zzz": 1}')
              WHEN event_id % 101 = 0 THEN '{"k": ' ELSE props END AS json
  FROM events)
"""


def pair_sql(body: str) -> str:
    return f"WITH {PAIR_SQL.strip()} {body}"


def items_sql(body: str) -> str:
    return f"WITH {ITEMS_SQL.strip()} {body}"


def json_sql(body: str) -> str:
    return f"WITH {JSON_SQL.strip()} {body}"
