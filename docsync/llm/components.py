"""Connected components of an edge table by alternating star contraction, as Spark jobs.

Every round is grouped minima and joins; no list of neighbours is ever built, so the centre
of a huge component is a grouped minimum with map-side combine. A join on such a centre is
left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node in ``edges(a, b)``; the component is its least node.

    Loops and repeated edges are allowed, nulls are not. Rounds grow with the logarithm of the
    longest path, not with component size.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = materialize(edges.select(*pair("a", "b")).where("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # Large star: higher neighbours of each node move to its least neighbour.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = (
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
            .join(low.withColumnRenamed("a", "u"), "u")
            .select(*pair("v", "m")).where("a <> b").distinct()
        )
        # Small star: each node and its lower neighbours move to the least of them.
        large = materialize(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("x"), "m")
            .union(low.select(F.col("a").alias("x"), "m"))
            .select(*pair("x", "m")).distinct()
        )
        edges = materialize(small, "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
