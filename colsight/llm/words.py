"""Words and shingles of whole Arrow text columns, as numpy arrays over the text bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Words and shingles are named by 64-bit
hashes: a polynomial over a random byte table, mixed. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Texts handled at once; a longer text is a chunk of its own."""

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(LOWER.astype(U) + U(0x9E3779B97F4A7C15))
STEP = U(0x2545F4914F6CDD1D)
GRAM = mix(np.arange(1, 9, dtype=U)) | U(1)
_powers = np.multiply.accumulate(np.full(256, STEP))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(2 * n, STEP))
    return _powers


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets of the rows in the bytes, bytes) of runs of rows of about ``limit`` bytes."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, offs[first : last + 1] - offs[first], data[offs[first] : offs[last]]
        first = last


def split(offs: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row where its words begin among them (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~space[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    rows = offs[:-1][offs[:-1] < len(data)]
    begins[rows] = solid[rows]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    rows = offs[1:][offs[1:] > 0] - 1
    ends[rows] = solid[rows]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    at = place + np.repeat(starts, size)
    value = code[data[at]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(U) * GRAM[7])


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array."""
    size = ends - starts
    until = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(until[-1]) + np.repeat(starts - until[:-1], size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(until), pa.py_buffer(data[at])).cast(pa.string())


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, over row borders too; position i is the run that begins at word i."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = word[:m] * GRAM[0]
    for k in range(1, n):
        total = total + word[k : m + k] * GRAM[k]
    return mix(total)


def short(word: np.ndarray) -> np.ndarray:
    """The whole sequence of a row with too few words, as one shingle that no longer run equals."""
    return mix((word * GRAM[: len(word)]).sum(keepdims=True) + GRAM[len(word)])


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct n-word shingles of each row) for runs of rows."""
    for first, offs, data in chunks(column):
        starts, ends, at = split(offs, data)
        word = hashes(data, starts, ends)
        run = grams(word, n)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.sort(run[a : b - n + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            else:
                sets.append(short(word[a:b]) if b > a else word[:0])
        yield first, sets
