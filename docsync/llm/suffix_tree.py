"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of up to ``depth`` words (the start of a text counts as a word of its own). The
root is the distribution of single tokens, absolutely discounted, with the discounted mass on
unknown words. A state s seen n times, with parent s' (its oldest word dropped), predicts

    P(t | s) = max(c(s, t) - D, 0) / n + a(s) P(t | s'),

over the transitions seen at least ``MIN_GRAM`` times, a(s) being what they leave over. It is
retained if the texts that it was counted on are likelier by it than by its parent, by
``THRESHOLD`` nats: n times the divergence of the two distributions. Parents of retained states are
retained. Each token is scored by the longest retained suffix of what comes before it.

Every word, context and transition of the texts counts, also those seen once.

* **Positions meet by context.** A position is a token with the ``depth`` words before it. Positions
  whose contexts end alike go, in packed form, to one slice of the hash space, which so holds all that
  its states were counted on: it counts, tests and scores them, and returns a sum for each text.
* **Frequent contexts** are too much for a slice. Those of an eighth of a slice or more are few; their
  transitions are counted over the cluster, level by level, and joined with the level below. Their
  positions go by the next longer context, or by text where there is none that is rarer.
* **Values from elsewhere**: a slice needs the counts of its words, and the probabilities of the
  transitions of frequent contexts. The most frequent of them (at most ``HEAD_WORDS`` words and
  ``HEAD_GRAMS`` n-grams, broadcast, 20 MB) are known everywhere; slices ask for the others by a join.
* **Rounds.** Slices are worked on in ``ROUNDS`` parts, so that only some positions lie on disk at once.

The bit map of what slices may ask for has 16 bits for each key and 64 MB at most; beyond, it lets more
through, which costs time and changes nothing.

Words, contexts and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.llm.words import WHITE_SPACE, mix, word_batches
from docsync.session import materialize

# Fewest occurrences of a transition and of a context, the latter also as a share of all tokens: all count.
# Discount; divergence test in nats.
MIN_GRAM, MIN_CONTEXT, MIN_SHARE = 1, 1, 0.0
DISCOUNT, THRESHOLD = 0.75, 8.0
# Words, and n-grams, that are known everywhere; most bits of a bit map as a power of two; positions
# packed at once; positions of a slice; blocks of a slice that are in memory one at a time; parts in which
# slices are worked on.
HEAD_WORDS, HEAD_GRAMS = 1 << 18, 1 << 20
MOST_BITS = 29
FLUSH, SLICE = 1 << 20, 1 << 21
BLOCKS, ROUNDS = 8, 2
START, END = np.uint64(0x51A27E57B0A1D3C5), np.uint64(0xE9D60F2B7C834A1F)


def join_keys(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The n-gram of a context and the n-gram that ends one word later."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + (suffix ^ np.uint64(0x632BE59BD9B4E019)))


def symbols(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets) with the start and the end of each text as symbols."""
    for low, high, words, offsets in word_batches(column, WHITE_SPACE):
        ends = offsets + 2 * np.arange(len(offsets))
        out = np.empty(ends[-1], np.uint64)
        inner = np.ones(len(out), bool)
        inner[ends[:-1]] = inner[ends[1:] - 1] = False
        out[inner], out[ends[:-1]], out[ends[1:] - 1] = words, START, END
        yield low, high, out, ends


def levels(words: np.ndarray, ends: np.ndarray, orders: int) -> list[np.ndarray]:
    """n-grams ending at each position, by order; ``level[d][i]`` holds where i is at least d - 1
    places behind the start of its text, and anything elsewhere."""
    out = [words]
    for _ in range(orders - 1):
        last = out[-1]
        out.append(np.concatenate([last[:1], join_keys(last[:-1], last[1:])]))
    return out


def places(ends: np.ndarray) -> np.ndarray:
    """Place of each symbol in its text."""
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each key in a bit map of 2**bits."""
    return [(k >> np.uint64(64 - bits)).astype(np.int64) for k in (keys, keys * np.uint64(0xD1342543DE82EF95))]


def find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among sorted ones, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in probes(keys, (len(bits) * 8).bit_length() - 1):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def bit_map(keys: DataFrame) -> np.ndarray:
    """Bit map of a column of keys. Parts meet in Spark; the driver gets each part once."""
    count = keys.count()
    size = min(max((16 * count).bit_length(), 16), MOST_BITS)
    part = 1 << (size - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in probes(batch.column(0).to_numpy().view(np.uint64), size):
                for number in np.unique(at // part).tolist():
                    bits = held.setdefault(number, np.zeros(part // 8, np.uint8))
                    own = at[at // part == number] % part
                    np.bitwise_or.at(bits, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        for number, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bits.tobytes()])], names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[number] = held.get(number, 0) | np.frombuffer(bits, np.uint8)
        for number, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bits.tobytes()])], names=["part", "bits"])

    schema = "part long, bits binary"
    out = np.zeros(1 << (size - 3), np.uint8)
    for row in keys.mapInArrow(run, schema).repartition(64, "part").mapInArrow(merge, schema).collect():
        start = row["part"] * part // 8
        out[start : start + part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


# ---- counting ----------------------------------------------------------------------------


def pack(context: np.ndarray, suffix: np.ndarray, count: np.ndarray) -> bytes:
    """Counts in order of context, as differences by byte planes, compressed."""
    by = np.argsort(context, kind="stable")
    planes = [np.diff(context[by], prepend=np.uint64(0)), suffix[by], count[by].astype(np.uint64)]
    return pa.compress(b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes() for p in planes), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=24 * size, codec="zstd", asbytes=True), np.uint8)
    planes = [np.ascontiguousarray(p.reshape(8, -1).T).view(np.uint64)[:, 0] for p in raw.reshape(3, -1)]
    return [np.cumsum(planes[0], dtype=np.uint64), planes[1], planes[2]]


def _key(order: int, context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return context if order == 1 else join_keys(context, suffix)


def _count(order: int, slices: int, contexts):
    """Texts to packed counts of n-grams, of some contexts, by slice of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        used = 0
        limits = (np.arange(1, slices).astype(object) * (1 << 64) // slices).astype(np.uint64) if slices > 1 else np.zeros(0, np.uint64)

        def flush() -> Iterator[pa.RecordBatch]:
            context, suffix = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            keys, first, count = np.unique(_key(order, context, suffix), return_index=True, return_counts=True)
            context, suffix = context[first], suffix[first]
            cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
            for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    data = pack(context[a:b], suffix[a:b], count[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([b - a], pa.int64()), pa.array([data], pa.binary())], names=["slice", "n", "data"])

        for batch in batches:
            for _, _, words, ends in symbols(batch.column(0)):
                if order == 1:
                    context, suffix = words, np.zeros(len(words), np.uint64)
                else:
                    below = levels(words, ends, order - 1)[-1]
                    at = np.flatnonzero(places(ends) >= order - 1)
                    at = at[find(contexts.value, below[at - 1]) >= 0]
                    context, suffix = below[at - 1], below[at]
                held.append((context, suffix))
                used += len(context)
                if used >= FLUSH:
                    yield from flush()
                    used = 0
        if used:
            yield from flush()

    return run


def _merge(order: int, least: int):
    """Packed counts of a slice to rows of the n-grams that are frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                context, suffix, count = (np.concatenate(x) for x in zip(*(unpack(p["data"], p["n"]) for p in parts), strict=True))
                keys, first, back = np.unique(_key(order, context, suffix), return_index=True, return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, back, count.astype(np.int64))
                some = np.flatnonzero(total >= least)
                for a in range(0, len(some), 1 << 16):
                    part = some[a : a + (1 << 16)]
                    columns = [keys[part], context[first[part]], suffix[first[part]]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(total[part])], names=["key", "context", "suffix", "c"])

    return run


def count_grams(texts: DataFrame, order: int, slices: int, contexts=None) -> DataFrame:
    """``(key, context, suffix, c)`` of the n-grams of one order in a column of texts; beyond words, of the given contexts."""
    packed = texts.mapInArrow(_count(order, slices, contexts), "slice int, n long, data binary")
    grouped = packed.groupBy("slice").agg(F.collect_list(F.struct("n", "data")).alias("parts")).select("parts")
    rows = grouped.mapInArrow(_merge(order, 1 if order == 1 else MIN_GRAM), "key long, context long, suffix long, c long")
    return materialize(rows, f"grams-{order}")


# ---- fitting -----------------------------------------------------------------------------


@dataclass
class Frequent:
    """Contexts of one length that are too frequent for a slice, in order of ``keys``.

    ``rest`` is what a state leaves to its parent, NaN for a context that is no state.
    """

    keys: np.ndarray
    parents: np.ndarray
    rest: np.ndarray
    keep: np.ndarray


@dataclass
class Model:
    """``counts(key, c)`` of the words, the frequent contexts, and ``grams(key, p, c)`` with the probabilities of
    their transitions. The states of the other contexts are grown from ``texts`` where positions meet them."""

    counts: DataFrame | None
    grams: DataFrame | None
    texts: DataFrame | None
    tokens: int
    words: int
    discount: float
    depth: int
    least: int = 1
    frequent: list[Frequent] = field(default_factory=list)

    def root(self, count: np.ndarray) -> np.ndarray:
        """log10 of the root's probability, by training counts."""
        if not self.tokens:
            return np.zeros(len(count))
        unknown = self.discount * self.words / self.tokens
        return np.log10(np.where(count > 0, (count - self.discount) / self.tokens, unknown))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def _slices(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(64, math.ceil(size / 6 / SLICE))


def fit(texts: DataFrame, depth: int = 2) -> Model:
    """A tree from a table's column ``text``; a null is an empty text."""
    spark = texts.sparkSession
    texts = texts.select("text")
    slices = _slices(texts)
    many = max(SLICE // 8, MIN_GRAM, 1)

    level = count_grams(texts, 1, slices)
    token = F.col("key") != int(START.view(np.int64))
    facts = level.agg(
        F.coalesce(F.sum(F.when(token, F.col("c"))), F.lit(0)).alias("tokens"), F.count_if(token).alias("words"),
        F.count_if(token & (F.col("c") == 1)).alias("once"), F.count_if(token & (F.col("c") == 2)).alias("twice"),
    ).first()
    least = max(MIN_CONTEXT, math.ceil(MIN_SHARE * facts["tokens"]))
    discount = min(max(facts["once"] / max(facts["once"] + 2 * facts["twice"], 1), 0.1), 0.9)
    counts = level.where(token).select("key", "c")
    grams = spark.createDataFrame([], "key long, p double, c long")
    model = Model(counts, grams, texts, facts["tokens"], facts["words"], discount, depth, least)

    below = counts.withColumn("p", (F.col("c") - discount) / F.lit(float(max(facts["tokens"], 1))))
    for order in range(2, depth + 2):
        # At most one context for each eighth of a slice.
        states = level.where(F.col("c") >= many).select(F.col("key").alias("context"), F.col("suffix").alias("parent"), F.col("c").alias("n"))
        hot = states.toArrow()
        keys, parents = (hot.column(c).to_numpy().view(np.uint64) for c in ("context", "parent"))
        by = np.argsort(keys)
        own = Frequent(keys[by], parents[by], np.full(len(keys), np.nan), np.zeros(len(keys), bool))
        model.frequent.append(own)
        if not len(keys):
            continue
        level = count_grams(texts, order, slices, spark.sparkContext.broadcast(own.keys))
        # The parent's probability of the same word, and the context's own count.
        under = below.select(F.col("key").alias("suffix"), F.col("p").alias("parent_p"))
        joined = materialize(level.join(under, "suffix").join(F.broadcast(states.where(F.col("n") >= least).select("context", "n")), "context"), f"joined-{order}")
        left = joined.groupBy("context").agg(F.sum("c").alias("seen"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("all"))
        left = left.select("context", "seen", ((F.col("all") - F.col("seen") + DISCOUNT * F.col("kinds")) / F.col("all")).alias("rest"))
        p = (F.col("c") - DISCOUNT) / F.col("n") + F.col("rest") * F.col("parent_p")
        below = materialize(joined.join(F.broadcast(left), "context").withColumn("p", p), f"level-{order}")
        gain = F.sum(F.col("c") * F.log(F.col("p") / F.col("parent_p"))) + F.max((F.col("n") - F.col("seen")) * F.log("rest"))
        test = below.groupBy("context").agg(F.max("rest").alias("rest"), gain.alias("gain")).toArrow()
        at = find(own.keys, test.column("context").to_numpy().view(np.uint64))
        own.rest[at], own.keep[at] = test.column("rest").to_numpy(), test.column("gain").to_numpy() >= THRESHOLD
        grams = grams.unionByName(below.select("key", "p", "c"))
    model.grams = grams
    _keep_parents(model.frequent)
    return model


def _keep_parents(frequent: list[Frequent]) -> None:
    """Parents of retained states are retained, from the longest contexts down."""
    for longer, shorter in zip(frequent[:0:-1], frequent[-2::-1], strict=True):
        shorter.keep[find(shorter.keys, longer.parents[longer.keep])] = True


# ---- scoring -----------------------------------------------------------------------------


def _head(entries: DataFrame, weight: str, most: int) -> tuple[list[np.ndarray], DataFrame]:
    """The most frequent entries, at most ``most``, as sorted arrays, and the others as a table.

    They are cut between eighths of octaves of the weight.
    """
    bucket = F.floor(F.log2(F.col(weight).cast("double")) * 8)
    room, cut = most, 1 << 20
    for row in sorted(entries.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):
        room -= row["count"]
        if room < 0:
            break
        cut = row["b"]
    value = next(c for c in entries.columns if c != "key")
    table = entries.where(bucket >= cut).select("key", value).toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return [keys[by], table.column(value).to_numpy().astype(float)[by]], materialize(entries.where(bucket < cut), "rare")


def look_up(head: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values by key; NaN where there is none."""
    known, value = head
    if not len(known):
        return np.full(len(keys), np.nan)
    some, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    return np.where(known[at] == some, value[at], np.nan)[back]


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns by byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return pickle.dumps(([(c.dtype.str, len(c)) for c in columns], len(raw), pa.compress(raw, codec="zstd", asbytes=True)))


def expand(data: bytes) -> list[np.ndarray]:
    shape, size, packed = pickle.loads(data)
    raw, out, at = np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), np.uint8), [], 0
    for kind, n in shape:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).reshape(-1).view(kind))
        at += width * n
    return out


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slices follow the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def _dealt(batch: pa.RecordBatch, model: Model, slices: int, low: int, high: int) -> Iterator[tuple]:
    """Positions of the slices from ``low`` up to ``high``: numbers of their symbols, symbols by order as from ``levels``,
    key that deals them to slices, place in the text, text."""
    for first, end, symbol, ends in symbols(batch.column(4)):
        place = places(ends)
        at = np.flatnonzero(place > 0)
        text = first + np.repeat(np.arange(end - first), np.diff(ends))
        grams = levels(symbol, ends, model.depth + 1)
        # By the shortest context that is rare enough; by text if there is none.
        row = batch.column(0).to_numpy()[text[at]].view(np.uint64)
        key, left = mix(row + np.uint64(0x9E3779B97F4A7C15) * (text[at].astype(np.uint64) * (row >> np.uint64(63)) + np.uint64(1))), np.arange(len(at))
        for d, own in enumerate(model.frequent, 1):
            left = left[place[at[left]] >= d]
            context = grams[d - 1][at[left] - 1]
            hot = find(own.keys, context) >= 0
            key[left[~hot]] = context[~hot]
            left = left[hot]
        number = _slice_of(key, slices)
        some = np.flatnonzero((number >= low) & (number < high))
        yield at[some], grams, key[some], place[at[some]], text[at[some]]


PACKED = "slice int, kind int, data binary"
POSITIONS, ANSWERS, TEXTS = 0, 1, 2


def _packed(number: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["slice", "kind", "data"])


def _send(tools, slices: int, low: int, high: int):
    """Texts to packed positions of some slices; in the first round, with what is returned of a text besides sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tools.value[0]
        held: list[tuple[np.ndarray, ...]] = []
        used = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, row, learned, words = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
            held.clear()
            block = _slice_of(key, slices * BLOCKS).astype(np.uint16 if slices * BLOCKS < 1 << 16 else np.uint64)
            by = np.argsort(block, kind="stable")
            block = block[by].astype(np.int64)
            number = block // BLOCKS
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                known, code = np.unique(words[:, by[a:b]], return_inverse=True)
                texts, first, text = np.unique(row[by[a:b]], return_index=True, return_inverse=True)
                data = squeeze(
                    np.diff(known, prepend=np.uint64(0)), np.diff(texts, prepend=0), learned[by[a:b]][first],
                    np.searchsorted(block[a:b], number[a] * BLOCKS + np.arange(BLOCKS + 1)), text.astype(np.uint32),
                    *code.reshape(len(words), b - a).astype(np.uint32),
                )
                yield _packed(int(number[a]), POSITIONS, data)

        for batch in batches:
            row, learned = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            if low == 0:
                own = np.flatnonzero(row >= 0)
                for part in np.unique(row[own] % slices).tolist() if len(own) else []:
                    some = own[row[own] % slices == part]
                    ids, named = batch.column(1).take(pa.array(some)), batch.column(1).is_valid().to_numpy(zero_copy_only=False)[some]
                    held_out = batch.column(2).to_numpy(zero_copy_only=False)[some].astype(bool)
                    yield _packed(part % max(high, 1), TEXTS, squeeze(row[some], ids.fill_null(0).to_numpy(), named, held_out))
            for at, grams, key, place, text in _dealt(batch, model, slices, low, high):
                words = np.stack([np.where(place >= d, grams[0][np.maximum(at - d, 0)], np.uint64(0)) for d in range(model.depth + 1)])
                held.append((key, row[text], learned[text], words))
                used += len(at)
                if used >= FLUSH:
                    yield from flush()
                    used = 0
        if used:
            yield from flush()

    return run


def _ask(tools, slices: int):
    """What slices need besides the heads: different keys of words and of transitions of frequent contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heads, bits = tools.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        used = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, number = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            by = np.lexsort((number, key))
            key, number = key[by], number[by]
            some = np.flatnonzero(np.diff(key, prepend=~key[:1]).astype(bool) | np.diff(number, prepend=-1).astype(bool))
            for a in range(0, len(some), 1 << 16):
                part = some[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(number[part], pa.int32())], names=["key", "slice"])

        for batch in batches:
            for at, grams, dealt, place, _ in _dealt(batch, model, slices, 0, slices):
                number = _slice_of(dealt, slices).astype(np.int32)
                for order, head in enumerate([heads[0], *[heads[1]] * model.depth]):
                    some = np.flatnonzero(place >= order)
                    if order:
                        some = some[find(model.frequent[order - 1].keys, grams[order - 1][at[some] - 1]) >= 0]
                    key = grams[order][at[some]]
                    lost = np.flatnonzero(find(head[0], key) < 0)
                    lost = lost[has_bit(bits, key[lost])]
                    held.append((key[lost], number[some[lost]]))
                    used += len(lost)
                if used >= FLUSH:
                    yield from flush()
                    used = 0
        if used:
            yield from flush()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, slice, value)`` to packed answers by slice."""
    held: list[list[np.ndarray]] = []
    used = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, number, value = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()
        by = np.lexsort((key, number))
        key, number, value = key[by].view(np.uint64), number[by], value[by]
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _packed(int(number[a]), ANSWERS, squeeze(np.diff(key[a:b], prepend=np.uint64(0)), value[a:b]))

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            used += batch.num_rows
        if used >= FLUSH:
            yield from flush()
            used = 0
    if used:
        yield from flush()


class Slice:
    """Positions that meet by their contexts: probabilities of each order, and which states are retained."""

    def __init__(self, model: Model, heads, answers: list[np.ndarray], words: list[np.ndarray], learned: np.ndarray):
        self.model, self.learned = model, learned
        grams, self.contexts = [words], []
        for _ in range(model.depth):
            last = grams[-1]
            grams.append([join_keys(b, a) for a, b in zip(last[:-1], last[1:], strict=True)])
        self.count = self.value(heads[0], answers, words[0])
        self.count = np.where(np.isnan(self.count), 0, self.count)
        self.p, self.kept = [10 ** replace(model, counts=None, grams=None, texts=None).root(self.count)], []
        #: By order: frequent context of each position or -1; positions of other contexts, their contexts, and which are kept.
        self.hot, self.own = [], []
        for d in range(1, model.depth + 1):
            there = words[d] != 0
            context, gram = grams[d - 1][1], grams[d][0]
            hot = np.where(there, find(model.frequent[d - 1].keys, context), -1)
            p = self.p[-1].copy()
            at = np.flatnonzero(hot >= 0)
            rest = model.frequent[d - 1].rest[hot[at]]
            at, rest = at[~np.isnan(rest)], rest[~np.isnan(rest)]
            value = self.value(heads[1], answers, gram[at])
            p[at] = np.where(np.isnan(value), rest * p[at], value)
            at = np.flatnonzero(there & (hot < 0))
            states, keep, p[at] = self.grow(context[at], gram[at], self.learned[at], p[at])
            self.hot.append(hot)
            self.own.append((at, states, keep))
            self.p.append(p)

    @staticmethod
    def value(head, answers, keys: np.ndarray) -> np.ndarray:
        out = look_up(head, keys)
        lost = np.flatnonzero(np.isnan(out))
        out[lost] = look_up(answers, keys[lost])
        return out

    def grow(self, context, gram, learned, parent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts by number, whether each is retained by the test, probabilities."""
        _, of = np.unique(context, return_inverse=True)
        _, first, kind = np.unique(gram, return_index=True, return_inverse=True)
        n, c = np.bincount(of, learned), np.bincount(kind, learned)
        state, below = of[first], parent[first]
        listed = (c >= MIN_GRAM) & (c > 0) & (n >= self.model.least)[state]
        kinds, seen = np.bincount(state, listed, len(n)), np.bincount(state, c * listed, len(n))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(kinds > 0, (n - seen + DISCOUNT * kinds) / n, 1.0)
            p = np.where(listed, (c - DISCOUNT) / n[state], 0.0) + rest[state] * below
        gain = np.bincount(state, np.where(listed, c * np.log(p / below), 0.0), len(n)) + np.where(kinds > 0, (n - seen) * np.log(rest), 0.0)
        return of, (kinds > 0) & (gain >= THRESHOLD), p[kind]

    def keep(self) -> list[np.ndarray]:
        """Frequent contexts, by order, that have a retained state of a slice as a child."""
        wanted, depth = [np.zeros(0, np.int64)] * self.model.depth, self.model.depth
        self.kept = [np.zeros(len(self.learned), bool) for _ in range(depth)]
        for d in range(depth - 1, -1, -1):
            at, states, keep = self.own[d]
            if d + 1 < depth:
                # Positions of a retained longer context have its parent as their context.
                keep[states[self.kept[d + 1][at]]] = True
            own, hot = self.kept[d], self.hot[d]
            own[at] = keep[states]
            some = np.flatnonzero(hot >= 0)
            own[some] = self.model.frequent[d].keep[hot[some]]
            if d + 1 < depth:
                wanted[d] = np.unique(hot[some[self.kept[d + 1][some] & ~own[some]]])
        return wanted

    def chance(self) -> np.ndarray:
        out = self.p[0]
        for p, kept in zip(self.p[1:], self.kept, strict=True):
            out = np.where(kept, p, out)
        return out


SUMS = "part int, data binary"


def _slices_of(batches: Iterator[pa.RecordBatch], model: Model, heads) -> Iterator[tuple]:
    """Packed parts of a slice to its blocks, one at a time, with the texts of their positions; and to rows of texts."""

    def blocks(packed: list, answers: list[np.ndarray]) -> Iterator[tuple[Slice, np.ndarray]]:
        packed = [(np.cumsum(known, dtype=np.uint64), np.cumsum(texts), *rest) for known, texts, *rest in packed]
        for number in range(BLOCKS):
            row, learned, words = [], [], []
            for known, texts, fitted, cuts, text, *codes in packed:
                some = slice(cuts[number], cuts[number + 1])
                row.append(texts[text[some]])
                learned.append(fitted[text[some]].astype(float))
                words.append([known[c[some]] for c in codes])
            row, learned = np.concatenate(row), np.concatenate(learned)
            if len(row):
                yield Slice(model, heads, answers, [np.concatenate(w) for w in zip(*words, strict=True)], learned), row

    for batch in batches:
        for number in range(batch.num_rows):
            parts = batch.column(0)[number].as_py()
            by_kind = [[expand(p["data"]) for p in parts if p["kind"] == kind] for kind in (POSITIONS, ANSWERS, TEXTS)]
            answers = [np.zeros(0, np.uint64), np.zeros(0)]
            if by_kind[ANSWERS]:
                key, value = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in by_kind[ANSWERS]]), np.concatenate([a[1] for a in by_kind[ANSWERS]])
                key, first = np.unique(key, return_index=True)
                answers = [key, value[first]]
            yield blocks(by_kind[POSITIONS], answers) if by_kind[POSITIONS] else iter(()), by_kind[TEXTS]


def _wanted(tools):
    """Slices to the numbers of frequent contexts, by order, that are parents of retained states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heads, _ = tools.value
        for blocks, _ in _slices_of(batches, model, heads):
            for d, some in ((d, some) for own, _ in blocks for d, some in enumerate(own.keep())):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d), pa.int32()), pa.array(some, pa.int64())], names=["d", "number"])

    return run


def _sums(tools, parts: int):
    """Slices to packed sums of texts: row, tokens, known ones, base and score; or row, id and held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heads, _ = tools.value
        numbers_only = replace(model, counts=None, grams=None, texts=None)

        def dealt(row: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            by = np.lexsort((row, row % parts))
            row, columns = row[by], [c[by] for c in columns]
            cuts = [0, *(np.flatnonzero(np.diff(row % parts)) + 1).tolist(), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    data = squeeze(np.diff(row[a:b], prepend=0), *(c[a:b] for c in columns))
                    yield pa.RecordBatch.from_arrays([pa.array([int(row[a] % parts)], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

        for blocks, texts in _slices_of(batches, model, heads):
            for facts in texts:
                yield from dealt(*facts)
            held: list[list[np.ndarray]] = []
            for own, row in blocks:
                own.keep()
                asked = np.flatnonzero(row >= 0)
                rows, of = np.unique(row[asked], return_inverse=True)
                count, chance = own.count[asked], own.chance()[asked]
                sums = [np.bincount(of, x, len(rows)) for x in (np.ones(len(of)), count > 0, numbers_only.base(count), np.log10(chance))]
                held.append([rows, *sums])
            if held:
                row, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                rows, of = np.unique(row, return_inverse=True)
                tokens, known, base, total = (np.bincount(of, x, len(rows)) for x in columns)
                yield from dealt(rows, tokens.astype(np.uint32), known.astype(np.uint32), base, total)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums of some texts to rows."""
    for batch in batches:
        for parts in batch.column(0).to_pylist():
            parts = [expand(p) for p in parts]
            facts = [np.concatenate(x) for x in zip(*([np.cumsum(p[0]), *p[1:]] for p in parts if len(p) == 4), strict=True)]
            sums = [np.concatenate(x) for x in zip(*([np.cumsum(p[0]), *p[1:]] for p in parts if len(p) == 5), strict=True)]
            by = np.argsort(facts[0])
            row, ids, named, held = (f[by] for f in facts)
            of = np.searchsorted(row, sums[0])
            tokens, known, base, score = (np.bincount(of, x, len(row)) for x in sums[1:])
            out = [pa.array(ids, mask=~named), pa.array(held), *(pa.array(x.astype(np.int64)) for x in (tokens, known)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, held_out: Column, learned: Column | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text.

    Scores are log10 probabilities of the lower-cased (A-Z) words between white space and one end;
    a null text is empty and has the end alone. Rows that repeat an id are rows of their own, a
    null id stays null. An empty table gives no rows. Texts are whole, however long; other columns
    are ignored. A model of no texts gives every token probability 1 in either score.

    ``learned`` says which rows of ``docs`` are the texts of the model, if all of them are there; they
    are read once then.
    """
    spark = docs.sparkSession
    (words, rare_words), (grams, rare_grams) = _head(model.counts, "c", HEAD_WORDS), _head(model.grams, "c", HEAD_GRAMS)
    known = rare_words.select("key", F.col("c").cast("double").alias("value")).unionByName(rare_grams.select("key", F.col("p").alias("value")))
    bits = bit_map(known.select("key"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
        (F.lit(False) if learned is None else learned).alias("learned"), "text",
    )
    if learned is None:
        rows = rows.unionByName(model.texts.select(
            F.lit(-1).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learned"), "text"
        ))
    slices = _slices(rows)
    edges = [slices * i // ROUNDS for i in range(ROUNDS + 1)]

    rounds = list(zip(edges[:-1], edges[1:], strict=True))

    def shared():
        return spark.sparkContext.broadcast((replace(model, counts=None, grams=None, texts=None), [words, grams], bits))

    def grouped(tools, low: int, high: int) -> DataFrame:
        sent = rows.mapInArrow(_send(tools, slices, low, high), PACKED)
        own = answers.where(F.col("slice").between(low, high - 1)).mapInArrow(_answer, PACKED)
        return sent.unionByName(own).groupBy("slice").agg(F.collect_list(F.struct("kind", "data")).alias("parts")).select("parts")

    tools = shared()
    asked = rows.mapInArrow(_ask(tools, slices), "key long, slice int")
    answers = materialize(asked.join(known, "key").select("key", "slice", "value"), "answers")
    if any((~f.keep & ~np.isnan(f.rest)).any() for f in model.frequent[:-1]):
        # Frequent states that fail the test themselves are retained if a longer one is.
        for low, high in rounds:
            for row in grouped(tools, low, high).mapInArrow(_wanted(tools), "d int, number long").distinct().collect():
                model.frequent[row["d"]].keep[row["number"]] = True
        _keep_parents(model.frequent)
        tools = shared()
    done = [materialize(grouped(tools, low, high).mapInArrow(_sums(tools, slices), SUMS), "sums") for low, high in rounds]
    totals = _union(done).groupBy("part").agg(F.collect_list("data").alias("parts")).select("parts")
    totals = totals.mapInArrow(_total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return totals.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def held_out() -> Column:
    """Rows that nothing is learned from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))


def score_held_out(docs: DataFrame, depth: int = 2) -> DataFrame:
    """Fit on the rows that are not held out, score all."""
    return score(docs, fit(docs.where(~held_out()), depth), held_out(), ~held_out())
