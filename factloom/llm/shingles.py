"""Vectorised word and shingle hashes over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z is lowered
first.  Words hash to 64 bits, shingles hash the sequence of their words'
hashes.  All work is numpy over the UTF-8 buffers, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix(steps + _U(seed)) | _U(1)


#: A random value for each byte; separators weigh nothing.
_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(0x51ED270B))[_LOWER]
_BYTE[_SPACE] = 0


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    row, n = 0, len(lengths)
    while row < n:
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield row, stop
        row = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and each row's number of words."""
    rows = len(column)
    texts = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high]
    offsets = offsets - low
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets)).astype(np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.empty(int(place.max()) + 1, dtype=np.uint64)
    powers[0] = 1
    powers[1:] = 0xD6E8FEB86659FD93
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[data[starts[0] :]] * powers[place], starts - starts[0])
    return mix(sums + _U(0x2545F4914F6CDD1D)), counts


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a slice, with repeats, and each row's number.

    A row with 1 to k-1 words has its whole sequence as its only shingle; a row
    without words or text has none.
    """
    words, counts = word_hashes(column)
    salts = odd_multipliers(k, seed=77)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not len(words):
        return words, sizes
    at = np.repeat(firsts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.repeat(np.minimum(counts, k), sizes)
    sums = mix(length.astype(np.uint64))
    for j in range(k):
        used = length > j
        term = mix(words[np.minimum(at + j, len(words) - 1)] * salts[j])
        sums += np.where(used, term * salts[j], _U(0))
    return mix(sums), sizes
