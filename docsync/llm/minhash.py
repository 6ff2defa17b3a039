"""Near-duplicate groups: SuperMinHash signatures, bands, verification on full shingle sets.

1. Each text becomes the set of its five-word shingles (64-bit hashes), a SuperMinHash
   signature and band keys. Texts with equal sets form one class, by grouped aggregation.
2. Classes that share a band key get a common block label (components over star edges from
   each key to its least class: one edge per class and key, never the pairs of a key).
3. Classes of a block are compared on their full sets. A block of more than ``cell`` classes is
   cut into cells, and each pair of cells is a separate piece of work of at most 2 * ``cell``
   sets, so that no task grows with the block. Only a spanning forest leaves a piece.
4. Components over the verified links.

All pairs inside a block are compared, so the bands only have to bring a pair into one block.
Their number follows from the similarity asked for: a pair that just reaches it shares no band with
probability below ``MISS`` (24 bands of 5 values for 0.85, 35 for 0.8).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.components import components
from docsync.llm.words import GOLD, WHITE_SPACE, mix, word_batches
from docsync.session import materialize

BAND_ROWS, MISS = 5, 1e-6
SHINGLE = 5
_ODD = np.array(
    [0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    np.uint64,
)


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their n + 1 offsets."""
    words = len(hashes)
    rolled = np.zeros(max(words - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += hashes[k : k + len(rolled)] * _ODD[k]
    rolled = mix(rolled)
    sets, at = [], np.zeros(len(offsets), np.int64)
    for row, (low, high) in enumerate(itertools.pairwise(offsets)):
        if high - low >= SHINGLE:
            own = np.unique(rolled[low : high - SHINGLE + 1])
        elif high > low:
            short = (hashes[low:high] * _ODD[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            own = mix(np.array([short], np.uint64))
        else:
            own = hashes[:0]
        sets.append(own)
        at[row + 1] = at[row] + len(own)
    return np.concatenate(sets) if sets else hashes[:0], at


def bands_for(percent: int) -> int:
    """Bands needed for a similarity. Signatures have at most 255 values, enough from 0.75 on."""
    bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** BAND_ROWS))) if percent < 100 else 1
    if bands * BAND_ROWS > 255:
        raise ValueError(f"similarity of {percent} % is too low for {BAND_ROWS} values a band")
    return bands


def superminhash(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One signature of ``size`` values per set.

    Element by element, a random permutation of the places is drawn step by step; at step j the
    place drawn gets at most j plus a random fraction. A set takes no further step when all its
    places hold values below j: no later one could be smaller. Steps are taken for all elements
    of many sets at once, which changes nothing, since minima do not depend on the order.
    """
    sets = len(at) - 1
    owner = np.repeat(np.arange(sets), np.diff(at))
    best = np.full(sets * size, 0xFFFFFFFF, np.uint32)
    live = np.arange(len(values))
    steps = np.arange(1, size + 1, dtype=np.uint64) * GOLD
    places = np.tile(np.arange(size, dtype=np.uint8), (len(values), 1))
    for j in range(size):
        draw = mix(values[live] + steps[j])
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        taken = places[live, k]
        places[live, k] = places[live, j]
        value = ((draw >> np.uint64(40)) | np.uint64(j << 24)).astype(np.uint32)
        np.minimum.at(best, owner[live] * size + taken, value)
        full = best.reshape(sets, size).max(axis=1) < ((j + 1) << 24)
        live = live[~full[owner[live]]]
        if not len(live):
            break
    return best.reshape(sets, size)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per signature and band."""
    bands = signatures.shape[1] // BAND_ROWS
    parts = signatures.reshape(len(signatures), bands, BAND_ROWS).astype(np.uint64)
    keys = mix((parts * _ODD[:BAND_ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * GOLD)
    return keys.view(np.int64)


def _small_sets(offsets: np.ndarray, limit: int = 100_000) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(offsets) - 1)
        yield row, end
        row = end


def _signatures(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Signatures; the places of one very large set are drawn in slices and merged by minimum."""
    out = []
    for low, high in _small_sets(at):
        own, own_at = values[at[low] : at[high]], at[low : high + 1] - at[low]
        if high - low == 1 and len(own) > 100_000:
            slices = [own[i : i + 100_000] for i in range(0, len(own), 100_000)]
            out.append(np.minimum.reduce([superminhash(s, np.array([0, len(s)]), size) for s in slices]))
        else:
            out.append(superminhash(own, own_at, size))
    return np.concatenate(out)


def _fingerprint(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, offsets in word_batches(batch.column(1), WHITE_SPACE):
                values, at = shingles(hashes, offsets)
                count = np.diff(at)
                some = count > 0
                sums = []
                for salt in (np.uint64(3), np.uint64(11)):
                    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values * GOLD + salt), dtype=np.uint64)))
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                keys = band_keys(_signatures(values, at, bands * BAND_ROWS))
                lists = pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32), pa.array(keys[some].reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(sums[0]), pa.array(sums[1]), pa.array(count), lists,
                    ],
                    names=["doc_id", "set_hi", "set_lo", "n_shingles", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to its shingle set as bytes; other columns pass."""
    for batch in batches:
        names = batch.schema.names
        text = names.index("text")
        for low, high, hashes, offsets in word_batches(batch.column(text), WHITE_SPACE):
            values, at = shingles(hashes, offsets)
            packed = pa.array([values[a:b].tobytes() for a, b in itertools.pairwise(at)], pa.binary())
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [packed if i == text else part.column(i) for i in range(len(names))],
                names=["shingles" if i == text else n for i, n in enumerate(names)],
            )


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links, by union-find."""
    parent = np.arange(len(ids))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((int(ids[x]), int(ids[y])))
    return kept


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j with 100 * |intersection| >= percent * |union|, counted exactly.

    Shingles held by one set alone cannot be in an intersection. The others form an indicator
    matrix, taken by slices of shingles; products of 0 and 1 in float32 are exact below 2**24.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[number]
    owner, number = owner[keep], renumbered[number[keep]]
    common = np.zeros((n, n), np.float32)
    total, width = int(shared.sum()), 4096
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    cuts = np.searchsorted(number, np.arange(0, total + width, width))
    for i, (low, high) in enumerate(itertools.pairwise(cuts)):
        if high == low:
            continue
        rows, local = np.unique(owner[low:high], return_inverse=True)
        part = np.zeros((len(rows), width), np.float32)
        part[local, number[low:high] - i * width] = 1
        common[np.ix_(rows, rows)] += part @ part.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    return np.nonzero(np.triu((100 * inter >= percent * union) & (inter > 0), 1))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, ids, sets = None, [], []

        def links():
            if len(ids) < 2:
                return []
            left, right = linked(sets, percent)
            return forest(np.array(ids), left, right)

        out: list[tuple[int, int]] = []
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for block, i, j, doc, packed in zip(*(c.to_pylist() for c in cols), strict=True):
                if (block, i, j) != piece:
                    out += links()
                    piece, ids, sets = (block, i, j), [], []
                ids.append(doc)
                sets.append(np.frombuffer(packed, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        out += links()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, cell: int = 256) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    ``percent``: least similarity, as 100 * intersection / union. Words end at white space and
    A-Z count as a-z; a text of fewer than five words is one shingle; a null or blank text has
    none and is linked with nothing. ``component_id`` is the least doc_id of the group.
    Rows that repeat a doc_id count by their own texts; texts with the same least doc_id count
    as linked. A null doc_id takes no part: its component is null and it is kept. Other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(
        docs.mapInArrow(_fingerprint(bands_for(percent)), "doc_id long, set_hi long, set_lo long, n_shingles long, bands array<long>"),
        "prints",
    )
    some = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        some.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    keys = materialize(
        some.join(classes.select("set_hi", "set_lo", F.col("rep").alias("doc_id")), ["set_hi", "set_lo", "doc_id"])
        .select("doc_id", F.explode("bands").alias("band")),
        "bands",
    )
    shared = keys.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    block_of = components(
        keys.join(shared.select("band", "least"), "band").where("doc_id <> least")
        .select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    )
    block_of = materialize(block_of.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "blocks")
    cells = block_of.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("cells"))
    placed = (
        block_of.join(cells, "block")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int"))
    )
    # Always by shuffle: a broadcast of ids would grow with the corpus.
    sets = docs.join(placed.hint("merge"), "doc_id").mapInArrow(
        _sets, "doc_id long, shingles binary, block long, cells int, own int"
    )
    pieces = materialize(
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .where("cells = 1 OR own <> other")
        .select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "shingles"),
        "pieces",
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    links = (
        pieces.repartitionByRange(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id")
        .mapInArrow(_verify(percent), "a long, b long")
    )
    found = components(links)
    # Copies take the component of their class; classes of one text without links need no row.
    grouped = (
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .where("copies > 1 OR component IS NOT NULL")
        .select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        prints.select("doc_id", "n_shingles", "set_hi", "set_lo")
        .join(grouped, ["set_hi", "set_lo"], "left")
        .select(
            "doc_id", "n_shingles", own.alias("component_id"),
            F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id.

    Rows of a null doc_id stay. Of rows that repeat a doc_id one stays, the least by text.
    """
    result = materialize(near_duplicates(docs, percent), "near")
    marked = result.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")
    )
    gone = marked.where("c <> doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    again = marked.where("n > 1 AND c = doc_id").select("doc_id")
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti")
    repeated = kept.join(again, "doc_id", "left_semi")
    first = repeated.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), *[c for c in docs.columns if c != "doc_id"])).alias("row"))
    return single.unionByName(first.select("doc_id", *[F.col("row")[c].alias(c) for c in docs.columns if c != "doc_id"]))
