"""Packing token pieces into sequences by a grouping genetic algorithm.

1. Each text becomes token ids and is cut into pieces; ids are made once, and only their
   digests and lengths are kept.
2. Pieces are dealt by hash of the row and its number among equal rows into shards of about
   ``SHARD`` pieces. Pieces that fill a sequence alone are done.
3. Every shard is evolved on several islands, a row each. A solution says which bin each piece
   is in. Crossover injects well-filled bins of one parent whole, keeps those bins of the other
   that share no piece with them, and best-fits the pieces left over. Between epochs each
   island's best solution migrates to the next island of its shard (a join on shard and island).
4. The best solution of a shard places its pieces.

A shard leaves at most a few bins partly empty, a share that falls with ``SHARD`` and does not
grow with the input. All work and memory is per shard.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.session import materialize

CAPACITY = 1024
END = 2
# Texts with white space all through such a window go to tokenizers; tiktoken fails on runs of some million.
WINDOW = 1 << 15
SHARD = 4096
ISLANDS, POPULATION, CHILDREN, EPOCHS = 3, 4, 6, 2
# Number of a row among equal ones, and how many such numbers are made from one row.
REPEAT, REPEATS = "repeat_of_row", 1 << 16
# Bit position of the shard number in a sequence id.
SHARD_STEP = 1 << 24


def ranks_path() -> str:
    """The byte-level vocabulary as ranks: the same ids as byte_bpe_50k.json, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def blank_run(text: str) -> bool:
    """Whether ``text`` holds a run of white space that may overflow tiktoken's stack.

    Any run of ``2 * WINDOW`` characters covers a window that starts at a multiple of ``WINDOW``.
    """
    return len(text) >= WINDOW and any(text[at : at + WINDOW].isspace() for at in range(0, len(text) - WINDOW + 1, WINDOW))


def load_encoder(path: str):
    """A function from text to ids, those of tokenizers with ``add_special_tokens=False``.

    A ``.json`` file is read by tokenizers, else by tiktoken. Beside ranks lies the ``.json`` of
    the same name: texts that hold one of its added tokens, or a very long run of white space,
    are encoded by tokenizers. Without it there are no added tokens, and such runs are an error.
    """
    from tokenizers import Tokenizer

    whole = path if path.endswith(".json") else os.path.splitext(path)[0] + ".json"
    slow, added = None, None
    if whole == path or os.path.exists(whole):
        tokenizer = Tokenizer.from_file(whole)
        slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if whole == path:
            return slow
        words = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        added = re.compile("|".join(map(re.escape, words))) if words else None
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if slow and (blank_run(text) or added and added.search(text)):
            return slow(text)
        return encoding.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for ``docs(doc_id, text)``.

    A null text is empty. ``end`` closes each document. Only documents of more than
    ``capacity`` ids are cut; all pieces but the first are then full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path or ranks_path())
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(itertools.pairwise(cuts)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], lengths: list[int], bin_of: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put each item into the open bin that it leaves least room in, or into a new one.

    Open bins are listed by room; a bit mask over rooms finds the least room that is enough.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for number, full in enumerate(fill):
        room = capacity - full
        if 0 < room < capacity:
            by_room[room].append(number)
            mask |= 1 << room
    for item in items:
        need = lengths[item]
        above = mask >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            number, room = len(fill), capacity
            fill.append(0)
        bin_of[item] = number
        fill[number] += need
        room -= need
        if room:
            by_room[room].append(number)
            mask |= 1 << room


def renumber(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(bin_of: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, the less even filling, which later bins can use better."""
    fill = np.bincount(bin_of, lengths)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def crossover(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Child with well-filled bins of ``one``, undisturbed bins of ``two``, the rest best-fitted."""
    fill = np.bincount(one, lengths) / capacity
    # Bins filled above a drawn level, each taken with even chance.
    inject = (fill >= rng.uniform(0.9, 1.0)) & (rng.random(len(fill)) < 0.5)
    given = inject[one]
    broken = np.bincount(two, given) > 0
    stays = ~broken[two]
    # A bin of the other parent that is far from full is opened again.
    loose = (np.bincount(two, lengths) < 0.97 * capacity) & (rng.random(len(broken)) < 0.5)
    stays &= ~loose[two]
    child = np.full(len(one), -1, np.int64)
    child[given] = one[given]
    child[stays & ~given] = two[stays & ~given] + len(fill)
    left = np.flatnonzero(child < 0)
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    sums = np.bincount(child[kept], lengths[kept]).astype(int).tolist() if kept.any() else []
    # Longest first; ties in drawn order.
    order = left[np.lexsort((rng.random(len(left)), -lengths[left]))]
    best_fit(order.tolist(), lengths.tolist(), child, sums, capacity)
    return renumber(child)


def first_solution(lengths: np.ndarray, capacity: int, rng, noise: float) -> np.ndarray:
    """Best fit of the items in falling order of their lengths, blurred by ``noise``."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bin_of = np.zeros(len(lengths), np.int64)
    best_fit(order.tolist(), lengths.tolist(), bin_of, [], capacity)
    return renumber(bin_of)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return -(-int(lengths.sum()) // capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng) -> list[np.ndarray]:
    """One epoch on one island; the best solution comes first. Ends early at the lower bound."""
    if not population:
        population = [first_solution(lengths, capacity, rng, 0.0 if i == 0 else 0.3 * i / POPULATION) for i in range(POPULATION)]
    rank = lambda s: fitness(s, lengths, capacity)
    population.sort(key=rank, reverse=True)
    for _ in range(CHILDREN):
        if -rank(population[0])[0] <= least_bins(lengths, capacity):
            break
        a, b = sorted(rng.integers(0, len(population), 2))
        child = crossover(population[a], population[b], lengths, capacity, rng)
        population.append(child)
        population.sort(key=rank, reverse=True)
        population.pop()
    return population[:POPULATION]


ISLAND = "shard long, island int, lengths binary, population array<binary>, bins int"


def _evolve(epoch: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                rng = np.random.default_rng([row["shard"], row["island"], epoch])
                old = [np.frombuffer(p, np.int32) for p in row["population"]]
                new = evolve(lengths, old, capacity, rng)
                row |= {"population": [p.astype(np.int32).tobytes() for p in new], "bins": int(new[0].max()) + 1}
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    SCHEMA = pa.schema([
        ("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()),
        ("population", pa.list_(pa.binary())), ("bins", pa.int32()),
    ])
    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(x, np.int32).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["shard", "lengths"])


def _places(capacity: int):
    """Bin and offset of each item of a shard, by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = np.frombuffer(packed, np.int32).astype(np.int64)
                bins = np.frombuffer(best, np.int32)
                order = np.argsort(bins, kind="stable")
                before = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
                first = np.concatenate(([True], np.diff(bins[order]) > 0))
                base = before[first][np.cumsum(first) - 1]
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - base
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(bins), shard)), pa.array(np.arange(1, len(bins) + 1, dtype=np.int32)),
                        pa.array(bins.astype(np.int64)), pa.array(offset),
                    ],
                    names=["shard", "rank", "bin", "offset"],
                )

    return run


def _number_repeats(pieces: DataFrame) -> DataFrame:
    """Equal rows numbered from 0 in the column ``REPEAT``: they are counted, then written out again."""
    most = F.lit(REPEATS).cast("long")
    counted = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias(REPEAT))
    # In steps, so that no row's array of numbers is long.
    steps = counted.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col(REPEAT) - 1, most)))
    numbers = F.sequence(F.col("low"), F.least(F.col("low") + most, F.col(REPEAT)) - 1)
    return steps.select(*pieces.columns, F.explode(numbers).alias(REPEAT))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``.

    Each length is 1 to ``capacity``. Offsets in a sequence have no gaps. Repeated rows are
    packed as often as they come. Shards are dealt by the whole row and its number among equal
    rows, so that repeats of a key, null ones too, spread over all of them.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = materialize(_number_repeats(pieces), "pieces")
    full = F.col("length") >= capacity
    counts = pieces.agg(F.count_if(~full).alias("short"), F.count_if(full).alias("full")).first()
    shards, full_shards = (max(1, -(-n // shard_size)) for n in counts)
    # Full pieces have shards of their own, so that neither kind thins out the other's.
    own_shards = F.when(full, F.lit(full_shards)).otherwise(F.lit(shards))
    columns = ",".join(f"`{c}`" for c in names)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*names, REPEAT, F.lit("shard")), own_shards)).drop(REPEAT)
    ranked = materialize(
        dealt.where(~full).withColumn(
            "rank", F.expr(f"row_number() OVER (PARTITION BY shard ORDER BY length DESC, {columns})")
        ),
        "ranked",
    )
    start = (
        ranked.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rank", "length"))).alias("x"))
        .select("shard", F.col("x.length").alias("lengths"))
        .mapInArrow(_lengths, "shard long, lengths binary")
        .select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths",
            F.array().cast("array<binary>").alias("population"), F.lit(0).alias("bins"),
        )
    )
    state = materialize(start, "islands")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    for epoch in range(EPOCHS):
        evolved = materialize(
            state.repartition(parts, "shard", "island").mapInArrow(_evolve(epoch, capacity), ISLAND), "islands"
        )
        # The best of each island replaces the worst of the next one.
        guests = evolved.select(
            "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("guest")
        )
        state = evolved.join(guests, ["shard", "island"]).select(
            "shard", "island", "lengths",
            F.concat(F.slice("population", 1, POPULATION - 1), F.array("guest")).alias("population"), "bins",
        )
    best = evolved.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", "b.island")
    placed = (
        evolved.join(best, ["shard", "island"]).select("shard", "lengths", F.col("population")[0].alias("best"))
        .mapInArrow(_places(capacity), "shard long, rank int, bin long, offset long")
    )
    shared = ranked.join(placed, ["shard", "rank"]).withColumn("sequence_id", F.col("shard") * SHARD_STEP + F.col("bin"))
    # Sequences of one full piece are numbered below zero, by row.
    alone = dealt.where(full).withColumn("offset", F.lit(0).cast("long")).withColumn(
        "sequence_id",
        -1 - F.expr(f"(row_number() OVER (PARTITION BY shard ORDER BY {columns}) - 1) * {full_shards}L + shard"),
    )
    out = [*names, "sequence_id", "offset"]
    return shared.select(out).unionByName(alone.select(out))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; one row per piece."""
    return pack(token_pieces(docs, path, capacity), capacity)
