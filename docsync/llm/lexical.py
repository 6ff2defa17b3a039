"""Ranked lexical search with a frequent-pattern tree of documents.

Documents are restricted to the terms that any item asks for, with terms in order of falling document
frequency, so that documents that share frequent terms share a path from the root of a trie.
Every node stores, for its subtree, the largest tf of each term and the smallest m. A term's part
of a score grows with tf and falls with m, so these bound every document below:

    sum over the item's terms of w * ((10^9 * tf_max) div (1000 * tf_max + 8 * m_min)).

Each item descends depth first, best bound first, and leaves out subtrees whose bound is below its
k-th score so far, or equal to it without a smaller doc_id below. Leaves are scored exactly.

1. Items become term vectors; they are taken in blocks of bounded size.
2. One pass over all documents gives their restricted vectors and lengths, one more pass over
   those the counts N, L and df.
3. Tries over at most 2,048 documents each are searched where the vectors lie; the k best of a task
   go to a shuffle by item. No document is sent anywhere.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.words import NOT_ALNUM, word_batches
from docsync.session import materialize

# An item block holds about so many different terms, a trie so many documents and vector entries.
BLOCK_TERMS = 1 << 18
TRIE_DOCS, TRIE_ENTRIES = 2048, 1 << 20
LEAF = 16
# Stands for a null id; larger than any other.
NO_ID = (1 << 63) - 1


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes cut from one array; ``ends`` are n + 1 offsets into ``values``."""
    size = values.dtype.itemsize
    if not len(values):
        return pa.array([b""] * (len(ends) - 1), pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _item_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term hashes and their repeats for each item."""
    for batch in batches:
        for low, high, hashes, offsets in word_batches(batch.column(1), NOT_ALNUM):
            parts = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[low:high], pa.array([t.tobytes() for t, _ in parts], pa.binary()),
                    pa.array([c.astype(np.int64).tobytes() for _, c in parts], pa.binary()), pa.array([len(t) for t, _ in parts], pa.int64()),
                ],
                names=["item_id", "terms", "repeats", "size"],
            )


def _restrict(vocabulary: np.ndarray):
    """Documents to ``(doc_id, n, terms, tf)``: numbers of known terms, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, offsets in word_batches(batch.column(1), NOT_ALNUM):
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[place] == hashes)
                row = np.searchsorted(offsets, known, side="right") - 1
                key, tf = np.unique(row * len(vocabulary) + place[known], return_counts=True)
                row, term = np.divmod(key, len(vocabulary))
                ends = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(np.diff(offsets)), binaries(term.astype(np.int32), ends), binaries(tf.astype(np.int32), ends)],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return run


def _frequencies(terms: int):
    """Documents holding each term in this task; N and L as the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms + 2, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            counts[terms:] += ((n > 0).sum(), n.sum())
            counts[:terms] += np.bincount(entries(batch.column(1))[0], minlength=terms)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    return run


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column end to end, and the n + 1 offsets of its rows."""
    parts = column.to_pylist()
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), np.int32), ends


class Trie:
    """Documents in order of their paths, and the nodes over ranges of them.

    ``ranks`` gives a term's place in the order of falling frequency. Paths that no further
    document shares are not spelled out, and neighbouring subtrees of fewer than ``LEAF``
    documents in all are one leaf.
    """

    def __init__(self, ids, m, terms, tf, ends, ranks):
        rows = np.repeat(np.arange(len(ids)), np.diff(ends))
        by = np.lexsort((ranks[terms], rows))
        path = ranks[terms][by].astype(">u4")
        paths = [path[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        shared = np.zeros(len(ids) + 1, np.int64)
        for i, (a, b) in enumerate(zip(order[:-1].tolist(), order[1:].tolist(), strict=True), 1):
            one, two = path[ends[a] : ends[a + 1]], path[ends[b] : ends[b + 1]]
            n = min(len(one), len(two))
            differ = one[:n] != two[:n]
            shared[i] = differ.argmax() if differ.any() else n if len(one) != len(two) else 1 << 40
        self.ids, self.m = ids[order], m[order]
        size = np.diff(ends)[order]
        self.ends = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(ends[:-1][order], size) + np.arange(self.ends[-1]) - np.repeat(self.ends[:-1], size)
        self.terms, self.tf = terms[by][pick], tf[by][pick].astype(np.int64)
        self._split(shared)
        self._bounds()

    def _split(self, shared: np.ndarray) -> None:
        """Nodes, parents before children: ranges, and children as lists of numbers."""
        self.low, self.high, self.children = [], [], []
        stack = [(0, len(self.ids), -1)]
        while stack:
            low, high, above = stack.pop()
            number = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            if above >= 0:
                self.children[above].append(number)
            inner = shared[low + 1 : high]
            if high - low <= LEAF or inner.min() >= 1 << 40:
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
            start = low
            for here, following in zip(cuts[1:-1], cuts[2:], strict=True):
                if following - start > LEAF:
                    stack.append((start, here, number))
                    start = here
            stack.append((start, high, number))

    def _bounds(self) -> None:
        """Of each subtree: the largest tf of its terms, the smallest m and the smallest id."""
        count = len(self.low)
        self.least_m, self.least_id = np.zeros(count, np.int64), np.zeros(count, np.int64)
        width = int(self.terms.max(initial=0)) + 1
        keys, most = [], []
        of_leaf: dict[int, tuple] = {}
        for node in range(count - 1, -1, -1):
            low, high, below = self.low[node], self.high[node], self.children[node]
            if below:
                term, tf = (np.concatenate([of_leaf[c][x] for c in below]) for x in (0, 1))
                for c in below:
                    del of_leaf[c]
            else:
                term, tf = (x[self.ends[low] : self.ends[high]] for x in (self.terms, self.tf))
            by = np.argsort(term, kind="stable")
            term, tf = term[by], tf[by]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            of_leaf[node] = (term[first], np.maximum.reduceat(tf, first) if len(first) else tf)
            keys.append(of_leaf[node][0].astype(np.int64) * count + node)
            most.append(of_leaf[node][1])
            self.least_m[node], self.least_id[node] = self.m[low:high].min(), self.ids[low:high].min()
        keys, most = np.concatenate(keys), np.concatenate(most)
        by = np.argsort(keys)
        keys, most = keys[by], most[by]
        # By term: its nodes and what one unit of weight counts there at most.
        self.starts = np.searchsorted(keys, np.arange(width + 1) * count)
        self.nodes = keys % count
        self.unit = share(most, self.least_m[self.nodes])

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document below a node scores more than this for an item."""
        out = np.zeros(len(self.low), np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            if term + 1 < len(self.starts):
                rows = slice(self.starts[term], self.starts[term + 1])
                out[self.nodes[rows]] += weight * self.unit[rows]
        return out

    def search(self, best: Best, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray) -> None:
        """Depth first; ``weight_of`` has the item's weights at its terms and zero elsewhere."""
        bound = self.bounds(terms, weights)
        bounds, least = bound.tolist(), self.least_id.tolist()
        stack = [0]
        while stack:
            node = stack.pop()
            top = bounds[node]
            if top <= 0 or top < best.kth or (top == best.kth and least[node] > best.last):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bounds.__getitem__)
                continue
            low, high = self.low[node], self.high[node]
            part = slice(self.ends[low], self.ends[high])
            weight = weight_of[self.terms[part]]
            some = np.flatnonzero(weight)
            row = np.searchsorted(self.ends[low : high + 1] - self.ends[low], some, side="right") - 1
            scores = np.zeros(high - low, np.int64)
            np.add.at(scores, row, weight[some] * share(self.tf[part][some], self.m[low:high][row]))
            best.offer(scores, self.ids[low:high])


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts per unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best documents of an item: highest scores, then smallest ids."""

    def __init__(self, k: int):
        self.k, self.kth, self.last = k, 0, NO_ID
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        able = scores >= max(self.kth, 1)
        if not able.any():
            return
        scores, ids = np.append(self.scores, scores[able]), np.append(self.ids, ids[able])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.kth, self.last = int(self.scores[-1]), int(self.ids[-1])


def _search(items: list[tuple], weight: np.ndarray, ranks: np.ndarray, documents: int, length: int, k: int):
    """The k best documents of a task for each item, over one trie after the other."""

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
        held: list[tuple] = []

        def build() -> Trie:
            ids, n, terms, tf = (np.concatenate([h[i] for h in held]) for i in range(4))
            m = np.array([25 + 75 * x * documents // length for x in n.tolist()], np.int64)
            ends = np.concatenate([[0], np.cumsum(np.concatenate([h[4] for h in held]))])
            return Trie(ids, m, terms, tf, ends, ranks)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            n = batch.column(1).to_numpy()
            (terms, ends), (tf, _) = entries(batch.column(2)), entries(batch.column(3))
            size = np.diff(ends)
            some = np.flatnonzero(size)  # a document without a known term scores 0
            row = 0
            while row < len(some):
                room = TRIE_DOCS - sum(len(h[0]) for h in held)
                used = sum(len(h[2]) for h in held)
                fits = int(np.searchsorted(np.cumsum(size[some[row:]]) + used, TRIE_ENTRIES, side="right"))
                take = min(room, max(fits, 0 if held else 1), len(some) - row)
                if take:
                    part = some[row : row + take]
                    low, high = ends[part[0]], ends[part[-1] + 1]
                    held.append((ids[part], n[part], terms[low:high], tf[low:high], size[part]))
                    row += take
                if row < len(some):
                    yield build()
                    held = []
        if held:
            yield build()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        scratch = np.zeros(len(weight), np.int64)
        for trie in tries(batches):
            for found, (_, terms, repeats) in zip(best, items, strict=True):
                weights = weight[terms] * repeats
                scratch[terms] = weights
                trie.search(found, terms, weights, scratch)
                scratch[terms] = 0
        size = [len(b.ids) for b in best]
        if sum(size):
            ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(items)), size), pa.int64()), pa.array([items[i][0] for i in np.repeat(np.arange(len(items)), size)], pa.int64()),
                    pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best])),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item with a score above 0.

    Null and empty texts have no terms: such items have no rows, such documents are in none and
    do not count. Of items that repeat an id the one of the least text counts; a null id is an id.
    Documents that repeat an id, or have none, are documents of their own; a null id comes last
    among equal scores (and 2**63 - 1 is taken for one). Empty tables give no rows. Texts are
    whole, however long. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    asked = materialize(asked.mapInArrow(_item_vectors, "item_id long, terms binary, repeats binary, size long"), "items").where("size > 0")
    blocks = math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / BLOCK_TERMS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == number).collect()
        if chosen:
            found = found.unionByName(_rank_block(texts, chosen, k))
    return found


def _rank_block(texts: DataFrame, chosen: list, k: int) -> DataFrame:
    """The same for one block of items."""
    chosen = sorted(chosen, key=lambda r: (r["item_id"] is None, r["item_id"] or 0))
    vocabulary = np.unique(np.concatenate([np.frombuffer(r["terms"], np.uint64) for r in chosen]))
    vectors = materialize(texts.mapInArrow(_restrict(vocabulary), "doc_id long, n long, terms binary, tf binary"), "vectors")
    counted = vectors.select("n", "terms").mapInArrow(_frequencies(len(vocabulary)), "term long, df long")
    counted = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 2, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    documents, length = int(df[-2]), int(df[-1])
    ranks = np.empty(len(vocabulary), np.int64)
    ranks[np.lexsort((vocabulary, -df[:-2]))] = np.arange(len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df[:-2].tolist()], np.int64)
    listed = [
        (r["item_id"], np.searchsorted(vocabulary, np.frombuffer(r["terms"], np.uint64)), np.frombuffer(r["repeats"], np.int64)) for r in chosen
    ]
    found = vectors.mapInArrow(_search(listed, weight, ranks, documents, max(length, 1), k), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM i GROUP BY ALL),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (
  SELECT item_id, doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
