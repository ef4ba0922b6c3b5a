"""Vectorised word splitting and hashing over Arrow string arrays.

Words are maximal runs of bytes outside a separator set. With the default set
(space, tab, newline, vertical tab, form feed, carriage return) that is exactly
``[^\\x20\\x09-\\x0D]+``: every separator is ASCII, so UTF-8 bytes do.

A text is walked in pieces of a few MB cut at separators, so memory stays
bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1_000_000
U64 = np.uint64

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Separators for comparisons that ignore punctuation: all of ASCII but letters and digits.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

#: ASCII lower-casing by byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Powers:
    """Powers of the hash base and of its inverse mod 2**64, grown on demand."""

    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of all rows of a batch, in order: hash, first byte and length; rows as offsets."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray  # row i has the words rows[i]:rows[i + 1]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def _pieces(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that cut no word."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + PIECE_BYTES, end)
        if stop < end:
            row = offsets[np.searchsorted(offsets, stop, side="right") - 1]
            if row > start:
                stop = int(row)
            else:  # inside a very long text: go on to the next separator
                while stop < end and not separators[data[stop]]:
                    window = separators[data[stop : stop + PIECE_BYTES]]
                    found = int(window.argmax())
                    stop += found if window[found] else len(window)
        yield start, stop
        start = stop


def words(column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    """Split every text of ``column`` and hash its words to 64 bits.

    The hash is a polynomial over the word's bytes, mixed with its length.
    """
    data, offsets = utf8(column)
    if fold is not None:
        data = fold[data]
    hashes, starts, lengths = [], [], []
    for a, b in _pieces(data, offsets, separators):
        part = data[a:b]
        word = ~separators[part]
        edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[edge] = False
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[edge[edge > 0] - 1] = False
        first = np.flatnonzero(word & ~before)
        last = np.flatnonzero(word & ~after) + 1
        if not len(first):
            continue
        up, down = _Powers.get(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=prefix[1:], dtype=U64)
        size = last - first
        hashes.append(mix((prefix[last] - prefix[first]) * down[first] + size.astype(U64)))
        starts.append(first + a)
        lengths.append(size)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(lengths), np.searchsorted(start, offsets).astype(np.int64))


def windows(w: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hashes of every run of ``size`` words within a row.

    Returns the hashes and, for each, the index of its first word.
    """
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    base = w.hashes if seed == 0 else mix(w.hashes, seed)
    out = []
    step = 1 << 18
    for a in range(0, n - size + 1, step):  # in blocks, so the powers stay few
        part = base[a : a + step + size - 1]
        up, down = _Powers.get(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * up[: len(part)], out=prefix[1:], dtype=U64)
        k = len(part) - size + 1
        out.append((prefix[size:] - prefix[:k]) * down[:k])
    row = w.row_of()
    at = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    return mix(np.concatenate(out)[at], size), at


def to_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list<int64> array: counts[i] of the values for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))
