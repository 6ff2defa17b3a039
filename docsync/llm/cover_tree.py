"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells by their nearest pivot and cells are cut into blocks of bounded
size, so that a crowded place becomes several blocks. Each block of data and each block of
queries becomes one cover tree: every node has a centre point, and a covering radius of all
points below it. For a query node (centre q, radius s) and a data node (centre p, radius r) no
inner product exceeds

    q.p + s |p| + r |q| + s r,

and the pair of nodes is pruned if that is below the worst k-th score so far in the query node.

1. Each query block is searched against one data block of its own cell, which gives k-th scores.
2. Query and data blocks meet as (centre, radius) summaries; pruned pairs move no vectors.
3. Surviving pairs of blocks are searched, tree against tree, a pair at a time.

Nothing is broadcast but the pivots and the sizes of their cells.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.sample import bounded_sample
from docsync.llm.vectors import LEAST_LONG, inner_products, scaled, smallest, usable
from docsync.session import materialize

BLOCK, QUERY_BLOCK = 1024, 512
ROWS_PER_PIVOT, MOST_PIVOTS = 4096, 1024
LEAF, FAN = 128, 12
SHRINK = 1.5


class Tree:
    """Cover tree of some points: nodes as arrays, points ordered so that a node is a range."""

    def __init__(self, packed: bytes):
        """From what :func:`grow_tree` returns."""
        for name, value in pickle.loads(packed).items():
            setattr(self, name, value)
        self.points = self.points.astype(float)
        self.centre = self.points[self.centre_at]
        self.size = np.sqrt((self.centre**2).sum(axis=1))
        self.children: list[list[int]] = [[] for _ in self.low]
        for node, above in enumerate(self.above.tolist()):
            if above >= 0:
                self.children[above].append(node)


def grow_tree(ids: np.ndarray, points: np.ndarray) -> bytes:
    """A tree as plain arrays: node ranges, centres, covering radii and parents, ids and points.

    Points take the smallest numbers that hold them.
    """
    order, nodes = np.arange(len(ids)), []
    stack = [(0, len(ids), 0, -1)]
    while stack:
        low, high, centre, above = stack.pop()
        own = order[low:high]
        away = np.sqrt(((points[own] - points[centre]) ** 2).sum(axis=1))
        number = len(nodes)
        nodes.append([low, high, centre, float(away.max()), above])
        if high - low <= LEAF or nodes[number][3] == 0:
            continue
        # Farthest-first centres until all points are covered within the shrunken radius.
        centres, near = [centre], away
        which = np.zeros(len(own), np.int64)
        while near.max() > nodes[number][3] / SHRINK and len(centres) < FAN:
            far = int(near.argmax())
            reach = np.sqrt(((points[own] - points[own[far]]) ** 2).sum(axis=1))
            which[reach < near] = len(centres)
            near = np.minimum(near, reach)
            centres.append(int(own[far]))
        by = np.argsort(which, kind="stable")
        order[low:high] = own[by]
        cuts = low + np.searchsorted(which[by], np.arange(len(centres) + 1))
        stack += [(int(a), int(b), c, number) for a, b, c in zip(cuts[:-1], cuts[1:], centres, strict=True) if b > a]
    table = np.array([n[:3] + n[4:] for n in nodes], np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pickle.dumps({
        "low": table[:, 0], "high": table[:, 1], "centre_at": place[table[:, 2]], "above": table[:, 3],
        "radius": np.array([n[3] for n in nodes]), "ids": ids[order], "points": smallest(points[order]),
    })


def bound(one: Tree, i: np.ndarray, two: Tree, j: np.ndarray) -> np.ndarray:
    """No score between points of nodes i and j is larger; slack covers rounding.

    Inner products below the least long count as it, so that no bound is lower.
    """
    inner = (one.centre[i] * two.centre[j]).sum(axis=1)
    s, r = one.radius[i], two.radius[j]
    total = s * two.size[j] + r * one.size[i] + s * r
    return np.maximum(inner + total + 1e-9 * (np.abs(inner) + total) + 1, float(LEAST_LONG))


class Best:
    """The k best (score, id) of each query of a tree, and the k-th scores."""

    def __init__(self, queries: int, k: int, kth: np.ndarray | None = None):
        self.k = k
        self.kth = np.full(queries, -np.inf) if kth is None else kth.astype(float)
        self.scores = [np.zeros(0, np.int64) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[query], scores), np.append(self.ids[query], ids)
        # ~x is -x - 1, which the least long has too.
        first = np.lexsort((ids, ~scores))[: self.k]
        self.scores[query], self.ids[query] = scores[first], ids[first]
        if len(first) == self.k:
            self.kth[query] = max(self.kth[query], self.scores[query][-1])


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Offer every data point that may be among a query's best; an own id never is."""
    worst = lambda nodes: np.array([best.kth[queries.low[n] : queries.high[n]].min() for n in nodes.tolist()])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[float, int, int]] = []
    while len(i):
        top = bound(queries, i, data, j)
        live = top >= worst(i)
        below_i, below_j = [], []
        for a, b, t in zip(i[live].tolist(), j[live].tolist(), top[live].tolist(), strict=True):
            left, right = queries.children[a] or [a], data.children[b] or [b]
            if left == [a] and right == [b]:
                leaves.append((t, a, b))
            else:
                below_i += [x for x in left for _ in right]
                below_j += [y for _ in left for y in right]
        i, j = np.array(below_i, np.int64), np.array(below_j, np.int64)
    for t, a, b in sorted(leaves, reverse=True):
        rows, cols = slice(queries.low[a], queries.high[a]), slice(data.low[b], data.high[b])
        if t < best.kth[rows].min():
            continue
        scores = inner_products(queries.points[rows], data.points[cols])
        able = (scores >= best.kth[rows][:, None]) & (queries.ids[rows][:, None] != data.ids[cols][None, :])
        for x in np.flatnonzero(able.any(axis=1)).tolist():
            best.offer(queries.low[a] + x, scores[x, able[x]], data.ids[cols][able[x]])


def _clean(rows: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with scaled components, of the rows that take part."""
    rows = rows.where(usable("embedding") & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding").alias("v"))


def _cells(pivots: np.ndarray):
    """Nearest pivot of each vector; the vector, padded to the pivots' dimension, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, pivots.shape[1]))
            for row, values in zip(rows, batch.column(1).to_pylist(), strict=True):
                row[: len(values)] = values
            near = ((pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T).argmin(axis=1)
            packed = pa.array([(r if np.abs(r).max(initial=0) >= 2**31 else r.astype(np.int32)).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), packed], names=["vec_id", "cell", "v"])

    return run


def unpack(vectors: list[bytes], dimension: int) -> np.ndarray:
    kinds = {4 * dimension: np.int32, 8 * dimension: np.float64}
    if not dimension:
        return np.zeros((len(vectors), 0))
    return np.array([np.frombuffer(v, kinds[len(v)]) for v in vectors], float)


def _grow(dimension: int):
    """A block's ids and vectors to its tree and summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cell, salt, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order = np.argsort(np.array(ids), kind="stable")
                packed = grow_tree(np.array(ids)[order], unpack([vectors[i] for i in order], dimension))
                tree = Tree(packed)
                yield pa.RecordBatch.from_pylist(
                    [{
                        "block": block, "cell": cell, "salt": salt, "centre": tree.centre[0].tolist(),
                        "radius": float(tree.radius[0]), "tree": packed,
                    }],
                    schema=pa.schema([
                        ("block", pa.int64()), ("cell", pa.int64()), ("salt", pa.int64()),
                        ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary()),
                    ]),
                )

    return run


def _blocks(rows: DataFrame, size: int, dimension: int, label: str) -> DataFrame:
    """``(block, cell, salt, centre, radius, tree)``: cells cut by the hash of id and row number."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("salts"))
    cut = rows.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", "row"), F.col("salts")))
    packed = cut.groupBy("cell", "salt").agg(F.collect_list(F.struct("vec_id", "v")).alias("x"))
    packed = packed.select(F.expr("cell * 4294967296L + salt").alias("block"), "cell", "salt", "x.vec_id", "x.v")
    return materialize(
        packed.mapInArrow(_grow(dimension), "block long, cell long, salt long, centre array<double>, radius double, tree binary"),
        label,
    )


def _search(k: int):
    """Rows (query block, query tree, k-th scores or null, data tree) to each query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                block, queries, kth, data = (c[x].as_py() for c in batch.columns)
                queries, data = Tree(queries), Tree(data)
                best = Best(len(queries.ids), k, None if kth is None else np.frombuffer(kth))
                search(queries, data, best)
                size = [len(s) for s in best.scores]
                # The k-th scores go with the block's first row.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.array([best.kth.tobytes()], pa.binary()),
                        pa.array([np.repeat(queries.ids, size).tolist()], pa.list_(pa.int64())),
                        pa.array([np.concatenate(best.ids).tolist()], pa.list_(pa.int64())),
                        pa.array([np.concatenate(best.scores).tolist()], pa.list_(pa.int64())),
                    ],
                    names=["block", "kth", "query_id", "vec_id", "score"],
                )

    return run


FOUND = "block long, kth binary, query_id array<long>, vec_id array<long>, score array<long>"


def top_k(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products of each query.

    ``queries`` and ``data`` are ``(vec_id, embedding)``; components x count as floor(256 x).
    Ties go to the smaller vec_id; a query never finds its own id. Null vectors, null ids and
    vectors with null or non-finite components take no part. Scores are exact however large the
    components are; one that does not fit a long counts as the nearest long. Shorter vectors count as padded by zeros. Of query rows that repeat an id the least vector counts; data
    rows that repeat one are separate candidates. Other columns are ignored.
    """
    spark = data.sparkSession
    points = materialize(_clean(data), "points")
    asked = _clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "asked")
    facts = points.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    dimension = max(facts["d"] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    wanted = min(max(facts["n"] // ROWS_PER_PIVOT, 1), MOST_PIVOTS)
    chosen = bounded_sample(points, "vec_id", wanted).limit(2 * MOST_PIVOTS).orderBy("vec_id").collect()
    pivots = np.zeros((max(len(chosen), 1), dimension))
    for row, pivot in zip(pivots, chosen, strict=False):
        row[: len(pivot["v"])] = pivot["v"]

    def celled(rows: DataFrame) -> DataFrame:
        # Numbered, so that rows that repeat an id are dealt to different blocks.
        cells = rows.mapInArrow(_cells(pivots), "vec_id long, cell long, v binary")
        return materialize(cells.withColumn("row", F.monotonically_increasing_id()), "cells")

    trees = _blocks(celled(points), BLOCK, dimension, "data-trees")
    groups = _blocks(celled(asked), QUERY_BLOCK, dimension, "query-trees")

    # One data block of the own cell for each query block.
    salts = trees.groupBy("cell").agg((F.max("salt") + 1).alias("salts"))
    home = groups.join(salts, "cell").select(
        F.col("block"), F.expr("cell * 4294967296L + pmod(salt, salts)").alias("home")
    )
    first = materialize(
        groups.select("block", "tree").join(home, "block")
        .join(trees.select(F.col("block").alias("home"), F.col("tree").alias("data_tree")), "home")
        .select("block", "tree", F.lit(None).cast("binary").alias("kth"), "data_tree")
        .mapInArrow(_search(k), FOUND),
        "first",
    )

    # Summaries of the other pairs, then the trees of those that may hold a better score.
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asking = groups.select("block", "centre", "radius").join(home, "block", "left").join(first.select("block", "kth"), "block", "left")
    asking = asking.join(_worst(first), "block", "left")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    spread = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    stored = trees.select(F.col("block").alias("data_block"), F.col("centre").alias("c"), F.col("radius").alias("r"), part.alias("part"))
    reach = (
        inner(F.col("centre"), F.col("c")) + F.col("radius") * length(F.col("c")) + F.col("r") * length(F.col("centre"))
        + F.col("radius") * F.col("r")
    )
    pairs = (
        spread.join(stored, "part").where("home IS NULL OR home <> data_block")
        .where(F.col("worst").isNull() | (F.greatest(reach + F.abs(reach) * 1e-9 + 1, F.lit(float(LEAST_LONG))) >= F.col("worst")))
        .select("block", "data_block", "kth")
    )
    second = (
        pairs.join(groups.select("block", "tree"), "block")
        .join(trees.select(F.col("block").alias("data_block"), F.col("tree").alias("data_tree")), "data_block")
        .select("block", "tree", "kth", "data_tree").mapInArrow(_search(k), FOUND)
    )
    found = first.unionByName(second).select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")).select("x.*")
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _worst(first: DataFrame) -> DataFrame:
    """Least k-th score of each query block; null where a query has fewer than k so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [np.frombuffer(k).min() for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x if np.isfinite(x) else None for x in least], pa.float64())], names=["block", "worst"]
            )

    return first.select("block", "kth").mapInArrow(run, "block long, worst double")
