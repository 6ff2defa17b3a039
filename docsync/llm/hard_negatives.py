"""Hard negatives by a GNAT-style multiway hyperplane tree.

Inner products are turned into distances: d(q, x)^2 = |q|^2 + |x|^2 - 2 q.x, so that a window of
scores is an annulus around the anchor, one for each range of lengths |x|.

* **Root, dealt over the cluster.** At most 256 split points are a bounded sample. Every row goes
  to its nearest split point, and for each pair of split point and cell the least and largest
  distance is kept. An anchor goes only to cells whose ranges meet its annuli, for all split
  points. Cells are cut into blocks of bounded size by a hash that also tells repeated ids apart.
* **Below, a tree per block.** Each node has up to 16 split points, its points go to the nearest,
  and each split point stores the range of its distances to every sibling subtree. A subtree is
  dropped as soon as one range does not meet [d - r, d + r], or lies inside the hole of the
  annulus. Leaves are scored exactly.

1. Anchors search their own cell for rows of the same label, which gives a first k-th score.
2. They search the other cells that may hold a better one: positives.
3. Each positive is a window of scores; anchors with their windows search for other labels.

What grows with the rows is never broadcast: joins of it are merge joins by hint, since Spark takes a
binary value for 100 bytes and compressed files for their rows, and so would send trees of hundreds of
megabytes through the driver. The driver gets the root only: split points, and ranges by cell.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.vectors import LEAST_LONG, MOST_LONG, inner_products, matrix, scaled, smallest, usable, width
from docsync.session import materialize

# Bounds of the index: split points at the root, rows of a block, anchors of a batch, tree shape.
MOST_CELLS, ROWS_PER_CELL = 256, 4096
BLOCK, ANCHORS = 2048, 512
FAN, LEAF = 16, 128
# Rows that are looked at for each split point of the root.
DRAWN = 16
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def split_points(points: np.ndarray, most: int) -> np.ndarray:
    """Rows far apart from each other, farthest first, from the first one; distinct points only."""
    chosen, near = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < most:
        far = int(near.argmax())
        if near[far] <= SLACK * (1 + np.abs(points[far]).max(initial=0)):
            break
        chosen.append(far)
        near = np.minimum(near, distances(points, points[far : far + 1])[:, 0])
    return np.array(chosen)


def ranges(away: np.ndarray, which: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance from each split point (column) to each cell: ``[point, cell]``."""
    low, high = np.full((cells, away.shape[1]), np.inf), np.full((cells, away.shape[1]), -np.inf)
    np.minimum.at(low, which, away)
    np.maximum.at(high, which, away)
    return low.T, high.T


class Split:
    """Split points, the ranges of their distances to each cell, and the cells' lengths."""

    def __init__(self, points, low, high, least, most):
        self.points, self.low, self.high, self.least, self.most = points, low, high, least, most

    def alive(self, away: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which cells may hold a score in [low, high]: ``[query, cell]``.

        ``away`` holds the queries' distances to the split points, ``square`` their squared
        lengths. Slack in proportion to the numbers covers rounding.
        """
        edge = square[:, None] + self.most[None, :] ** 2
        outer = edge - 2 * low[:, None] + SLACK * (edge + np.abs(low)[:, None] + 1)
        inner = square[:, None] + self.least[None, :] ** 2 - 2 * high[:, None]
        inner = inner - SLACK * (edge + np.abs(high)[:, None] + 1)
        ok = outer >= 0
        outer, inner = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
        for point in range(len(self.points)):
            d = away[:, point : point + 1]
            slack = SLACK * (d + self.high[point][None, :] + 1)
            least = np.maximum(d - outer, inner - d) - slack
            ok &= (least <= self.high[point][None, :]) & (d + outer + slack >= self.low[point][None, :])
        return ok


class Tree:
    """A block's points in leaf order, and its nodes."""

    def __init__(self, packed: bytes):
        self.ids, self.labels, points, self.nodes = pickle.loads(packed)
        self.points = points.astype(float)


def grow(ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> bytes:
    """The tree of a block. Nodes are ``(low, high, split, children)``; leaves have no split."""
    order, nodes = np.arange(len(ids)), []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        low, high, above, place = stack.pop()
        own, number = order[low:high], len(nodes)
        nodes.append([low, high, None, []])
        if above >= 0:
            nodes[above][3][place] = number
        if high - low <= LEAF:
            continue
        x = points[own]
        chosen = split_points(x, FAN)
        if len(chosen) < 2:
            continue
        away = distances(x, x[chosen])
        which = away.argmin(axis=1)
        which[chosen] = np.arange(len(chosen))
        length = np.sqrt((x**2).sum(axis=1))
        least = np.array([length[which == c].min() for c in range(len(chosen))])
        most = np.array([length[which == c].max() for c in range(len(chosen))])
        nodes[number][2] = (x[chosen], *ranges(away, which, len(chosen)), least, most)
        nodes[number][3] = [-1] * len(chosen)
        by = np.argsort(which, kind="stable")
        order[low:high] = own[by]
        cuts = low + np.searchsorted(which[by], np.arange(len(chosen) + 1))
        stack += [(int(a), int(b), number, c) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return pickle.dumps((ids[order], labels[order], smallest(points[order]), nodes))


class Asked:
    """Windows of scores of some anchors, and the best rows found for each.

    ``anchor`` names the anchor of each window; ``low`` rises to the k-th score found.
    """

    def __init__(self, points, ids, labels, anchor, low, high, k, same):
        self.points, self.ids, self.labels, self.anchor, self.k, self.same = points, ids, labels, anchor, k, same
        self.low, self.high = low.copy(), high
        self.square = (points**2).sum(axis=1)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in anchor]

    def offer(self, windows: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Score a leaf exactly."""
        anchors, place = np.unique(self.anchor[windows], return_inverse=True)
        scores = inner_products(self.points[anchors], points)
        able = self.ids[anchors][:, None] != ids[None, :]
        able &= (self.labels[anchors][:, None] == labels[None, :]) == self.same
        scores, able = scores[place], able[place]
        hit = able & (scores >= self.low[windows][:, None]) & (scores <= self.high[windows][:, None])
        for x in np.flatnonzero(hit.any(axis=1)).tolist():
            window = int(windows[x])
            s = np.append(self.found[window][0], scores[x, hit[x]])
            i = np.append(self.found[window][1], ids[hit[x]])
            first = np.lexsort((i, ~s))[: self.k]
            self.found[window] = (s[first], i[first])
            if len(first) == self.k:
                self.low[window] = s[first[-1]]


def search(tree: Tree, asked: Asked) -> None:
    """Descend with the windows that are still alive; nearest subtrees first."""
    splits = {}
    stack = [(0, np.arange(len(asked.anchor)))]
    while stack:
        number, windows = stack.pop()
        low, high, split, children = tree.nodes[number]
        if split is None:
            asked.offer(windows, tree.points[low:high], tree.ids[low:high], tree.labels[low:high])
            continue
        split = splits.setdefault(number, Split(*split))
        anchors, place = np.unique(asked.anchor[windows], return_inverse=True)
        away = distances(asked.points[anchors], split.points)[place]
        ok = split.alive(away, asked.square[asked.anchor[windows]], asked.low[windows].astype(float), asked.high[windows].astype(float))
        for c in np.argsort(-away.mean(axis=0), kind="stable").tolist():
            if ok[:, c].any():
                stack.append((children[c], windows[ok[:, c]]))


# ---- Spark -------------------------------------------------------------------------------


def _deal(points: np.ndarray, dimension: int):
    """Rows to the cell of their nearest split point; vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(2), dimension)
            cell = distances(rows, points).argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["vec_id", "label", "cell", "v"],
            )

    return run


def _grow(points: np.ndarray, dimension: int):
    """A block to its tree, and its ranges to all split points of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, labels, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(b"".join(vectors)).reshape(len(ids), dimension)
                order = np.lexsort((*rows.T[::-1], labels, ids))
                rows = rows[order]
                away, length = distances(rows, points), np.sqrt((rows**2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cell], pa.int64()), pa.array([grow(np.array(ids)[order], np.array(labels)[order], rows)], pa.binary()),
                        pa.array([away.min(axis=0).tobytes()], pa.binary()), pa.array([away.max(axis=0).tobytes()], pa.binary()),
                        pa.array([length.min()]), pa.array([length.max()]),
                    ],
                    names=["cell", "tree", "near", "far", "least", "most"],
                )

    return run


def _ranges(trees: DataFrame, points: np.ndarray) -> tuple[Split, np.ndarray]:
    """The root: ranges of every split point and cell, and which cells have rows.

    Ranges of blocks meet per cell before they come to the driver: at most 256 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for cell, near, far, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [np.frombuffer(near), np.frombuffer(far), least, most]
                was = best.get(cell, row)
                best[cell] = [np.minimum(was[0], row[0]), np.maximum(was[1], row[1]), min(was[2], row[2]), max(was[3], row[3])]
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(best), pa.int64()), pa.array([b[0].tobytes() for b in best.values()], pa.binary()),
                    pa.array([b[1].tobytes() for b in best.values()], pa.binary()),
                    pa.array([b[2] for b in best.values()], pa.float64()), pa.array([b[3] for b in best.values()], pa.float64()),
                ],
                names=["cell", "near", "far", "least", "most"],
            )

    schema = "cell long, near binary, far binary, least double, most double"
    parts = trees.select("cell", "near", "far", "least", "most").mapInArrow(run, schema)
    cells = len(points)
    merged = parts.repartition(min(cells, 16), "cell").mapInArrow(run, schema).collect()
    near, far = np.full((cells, cells), np.inf), np.full((cells, cells), -np.inf)
    least, most, there = np.zeros(cells), np.zeros(cells), np.zeros(cells, bool)
    for row in merged:
        near[:, row["cell"]], far[:, row["cell"]] = np.frombuffer(row["near"]), np.frombuffer(row["far"])
        least[row["cell"]], most[row["cell"]], there[row["cell"]] = row["least"], row["most"], True
    return Split(points, near, far, least, most), there


ASKED = "anchor_id long, label long, cell long, v binary, slot array<int>, low array<long>, high array<long>"


def _send(root: Split, there: np.ndarray, dimension: int, home: bool):
    """Anchors with their windows to every cell that may hold a row, or not their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column(4).to_pylist()], np.int64)
            if not size.sum():
                continue
            points = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(batch.num_rows, dimension)
            away, square = distances(points, root.points), (points**2).sum(axis=1)
            owner = np.repeat(np.arange(batch.num_rows), size)
            low, high = (batch.column(n).flatten().to_numpy().astype(float) for n in (5, 6))
            ok = np.zeros((batch.num_rows, len(there)), bool)
            for a in range(0, len(owner), 4096):
                part = owner[a : a + 4096]
                np.logical_or.at(ok, part, root.alive(away[part], square[part], low[a : a + 4096], high[a : a + 4096]))
            ok &= there[None, :]
            if home:
                ok[np.arange(batch.num_rows), batch.column(2).to_numpy()] = False
            row, cell = np.nonzero(ok)
            for a in range(0, len(row), 2048):
                part = batch.take(pa.array(row[a : a + 2048]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cell[a : a + 2048], pa.int64()), *part.columns[3:]], names=batch.schema.names
                )

    return run


FOUND = "anchor_id long, slot int, vec_id long, score long"


def _search(k: int, same: bool, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                tree, rows = Tree(batch.column(0)[x].as_py()), batch.column(1)[x].as_py()
                size = [len(r["slot"]) for r in rows]
                points = np.frombuffer(b"".join(r["v"] for r in rows)).reshape(len(rows), dimension)
                flat = lambda name: np.array([y for r in rows for y in r[name]], np.int64)
                owner, slot = np.repeat(np.arange(len(rows)), size), flat("slot")
                ids = np.array([r["anchor_id"] for r in rows])
                asked = Asked(points, ids, np.array([r["label"] for r in rows]), owner, flat("low"), flat("high"), k, same)
                search(tree, asked)
                n = [len(s) for s, _ in asked.found]
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[owner], n), pa.int64()), pa.array(np.repeat(slot, n), pa.int32()),
                            pa.array(np.concatenate([i for _, i in asked.found]), pa.int64()),
                            pa.array(np.concatenate([s for s, _ in asked.found]), pa.int64()),
                        ],
                        names=["anchor_id", "slot", "vec_id", "score"],
                    )

    return run


def _visit(sent: DataFrame, trees: DataFrame, k: int, same: bool, dimension: int) -> DataFrame:
    """Anchors meet the blocks of their cells, in batches of about 512."""
    counts = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(ANCHORS)).alias("batches"))
    packed = (
        sent.join(F.broadcast(counts), "cell")  # at most 256 rows
        .withColumn("batch", F.pmod(F.xxhash64("anchor_id"), F.col("batches")))
        .groupBy("cell", "batch")
        .agg(F.collect_list(F.struct("anchor_id", "label", "v", "slot", "low", "high")).alias("asked"))
    )
    return packed.join(trees.select("cell", "tree").hint("merge"), "cell").select("tree", "asked").mapInArrow(_search(k, same, dimension), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    anchors: DataFrame, data: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` and ``data`` are ``(vec_id, embedding, label)``. An anchor's positives are its
    ``positives`` best rows of its label; for each, the ``negatives`` best rows of other labels
    whose score is at least window[0] and at most window[1] per cent of the positive's. Scores
    are exact inner products of floor(256 x); equal ones go by the smaller vec_id, and what does
    not fit a long counts as the nearest long.

    Rows with a null id, label or vector, or with null or non-finite components take no part. An
    anchor never meets rows of its own id. Shorter vectors count as padded by zeros. Of anchors that
    repeat an id the least (vector, label) counts; other rows that repeat one are separate
    candidates. Anchors without positives, and positives without a row in their window, give no
    rows; nor do empty tables. Other columns are ignored.
    """
    spark = data.sparkSession

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled("embedding").alias("v"))

    rows = materialize(clean(data), "points")
    asked = clean(anchors).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v")
    asked = materialize(asked, "anchors")
    dimension, count = width(rows, asked), rows.count()

    # Split points: the rows of least hash, a top-k of bounded size.
    wanted = min(max(count // ROWS_PER_CELL, 1), MOST_CELLS)
    # Every task sends its own; few rows of all tables but the smallest have a hash below the share's, so that
    # what the driver gets doesn't grow with the tasks.
    order = [F.xxhash64("vec_id", "v"), "vec_id", "label", "v"]
    below = max(LEAST_LONG + (1 << 64) * min(DRAWN * wanted, count) // max(count, 1) - 1, LEAST_LONG)
    chosen = rows.where(order[0] <= below).select("v").orderBy(*order).limit(wanted).collect()
    if len(chosen) < wanted:
        chosen = rows.select("v").orderBy(*order).limit(wanted).collect()
    points = np.zeros((max(len(chosen), 1), dimension))
    for point, row in zip(points, chosen, strict=False):
        point[: len(row["v"])] = row["v"]
    points = np.unique(points, axis=0)

    celled = "vec_id long, label long, cell long, v binary"
    dealt = materialize(rows.mapInArrow(_deal(points, dimension), celled), "cells")
    asked = materialize(asked.mapInArrow(_deal(points, dimension), celled), "asked")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    # Repeats of one row are told apart by where they were written, which is fixed by now.
    numbered = dealt.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(sizes), "cell")  # at most 256 rows
    blocks = numbered.withColumn("block", F.pmod(F.xxhash64("vec_id", "at"), F.col("blocks")))
    grown = (
        blocks.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("x"))
        .select("cell", "x.vec_id", "x.label", "x.v")
        .mapInArrow(_grow(points, dimension), "cell long, tree binary, near binary, far binary, least double, most double")
    )
    trees = materialize(grown, "trees")
    root, there = _ranges(trees, points)

    whole = [F.array(F.lit(0)).alias("slot"), F.array(F.lit(LEAST_LONG)).alias("low"), F.array(F.lit(MOST_LONG)).alias("high")]
    own = asked.select(F.col("vec_id").alias("anchor_id"), "label", "cell", "v", *whole)
    at_home = _best(materialize(_visit(own, trees, positives, True, dimension), "home"), positives)
    at_home = materialize(at_home.select("anchor_id", "vec_id", "score", "rank"), "home-best")
    kth = at_home.where(F.col("rank") == positives).select("anchor_id", F.array("score").alias("kth"))
    better = own.join(kth.hint("merge"), "anchor_id", "left").withColumn("low", F.coalesce("kth", "low")).select(own.columns)
    sent = materialize(better.mapInArrow(_send(root, there, dimension, True), ASKED), "sent")
    elsewhere = _visit(sent, trees, positives, True, dimension).select("anchor_id", "vec_id", "score")
    both = at_home.select("anchor_id", "vec_id", "score").unionByName(elsewhere).withColumn("slot", F.lit(0))
    found = _best(both, positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = materialize(found, "positives")

    def share(percent: int, rounded) -> Column:
        """A percentage of the score as a whole number, by parts that fit a long."""
        score = F.col("positive_score")
        return (percent * F.expr("positive_score div 100") + rounded(percent * (score % 100) / 100)).cast("long")

    windows = found.withColumn("w", F.struct("slot", share(window[0], F.ceil).alias("low"), share(window[1], F.floor).alias("high")))
    windows = windows.where("w.low <= w.high").groupBy("anchor_id").agg(F.collect_list("w").alias("w"))
    asking = own.select("anchor_id", "label", "cell", "v").join(windows.hint("merge"), "anchor_id")
    asking = asking.select("anchor_id", "label", "cell", "v", F.col("w.slot").alias("slot"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    sent = materialize(asking.mapInArrow(_send(root, there, dimension, False), ASKED), "sent")
    best = _best(_visit(sent, trees, negatives, False, dimension), negatives)
    return best.join(found.hint("merge"), ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, d.vec_id, q.label = d.label AS same,
    CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, d.e)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
