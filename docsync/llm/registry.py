"""Registered queries of the corpus operators; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.llm import cover_tree, decontaminate, hard_negatives, html_text, langid, lexical, licenses, packing, quality, suffix_tree, toxicity, warc
from docsync.llm.minhash import near_duplicates
from docsync.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Arrow batches are kept small, since texts may be long.

    Tables written on the way are compressed by zstd: smaller on the shared disk than the
    default, and read through heap buffers, where the default codec leaves direct buffers to the
    garbage collector. Shuffle files go when the action that wrote them has ended.
    """
    tune(spark)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(rows.where("vec_id % 50 = 0"), rows, k=5)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives.mine(rows.where("vec_id % 50 = 0"), rows)


def op13_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_cover_tree": op3_cover_tree,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op10_warc": op10_warc,
    "op9_decontamination": op9_decontamination,
    "op11_lexical": op11_lexical,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_tree": op13_suffix_tree,
}

# Exact scores as sums over positions; the query set is one row in fifty against all rows.
TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, d.e)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op3_cover_tree": TOP_K,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
