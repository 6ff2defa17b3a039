"""Word hashing over Arrow string buffers, shared by the operators on text.

Texts stay UTF-8 bytes from the Arrow buffer to the word hashes; no Python string is made per
word. Work goes through in chunks of about half a megabyte, so memory does not follow the
batch size; only a single document longer than that makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
GOLD = np.uint64(0x9E3779B97F4A7C15)

_RNG = np.random.default_rng(20240917)
# One random odd 64-bit value per byte value.
BYTE_VALUES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table over byte values that is true inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Separators by contract: white space only, or everything in ASCII but letters and digits.
WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8), bounds


def chunks(bounds: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bounds(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word, and which bytes are in words. A word never crosses a text end."""
    word = ~separator[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= word[inner]
    return np.flatnonzero(first), word


def hash_words(
    data: np.ndarray, bounds: np.ndarray, separator: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the n + 1 word offsets of the texts.

    ``bounds`` are byte offsets into ``data`` and start at 0.
    """
    starts, word = word_bounds(data, bounds, separator)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(len(data))
    since = np.zeros(len(data), np.int64)
    since[starts] = starts
    since = place - np.maximum.accumulate(since)
    since[~word] = 0
    value = BYTE_VALUES[data] * powers(int(since.max()) + 1)[since]
    value[~word] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, bounds).astype(np.int64)


def hash_stems(
    data: np.ndarray, bounds: np.ndarray, separator: np.ndarray, lengths: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words' first bytes, for each of ``lengths`` that a word is longer than.

    With the number of the word that each belongs to, in no particular order.
    """
    starts, word = word_bounds(data, bounds, separator)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.add.reduceat(word.astype(np.int64), starts)
    power = powers(max(lengths))
    hashes, owners = [], []
    total, done = np.zeros(len(starts), np.uint64), 0
    number = np.arange(len(starts))
    for n in sorted(lengths):
        longer = size > n
        starts, size, total, number = starts[longer], size[longer], total[longer], number[longer]
        for j in range(done, n):
            total = total + BYTE_VALUES[data[starts + j]] * power[j]
        done = n
        hashes.append(mix(total ^ (np.uint64(n) << np.uint64(56))))
        owners.append(number)
    return np.concatenate(hashes), np.concatenate(owners)


def word_batches(
    column: pa.Array, separator: np.ndarray, lower: np.ndarray = LOWER
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets) for chunks of a string column."""
    data, bounds = utf8(column)
    for low, high in chunks(bounds):
        part = lower[data[bounds[low] : bounds[high]]]
        hashes, offsets = hash_words(part, bounds[low : high + 1] - bounds[low], separator)
        yield low, high, hashes, offsets
