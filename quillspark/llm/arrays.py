"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns; they are cut in blocks of bounded bytes and
worked on as one byte array each, so that no step loops over words in Python.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
#: Bytes of a word that are hashed eight at a time; longer words are rare.
LONG = 64
U64 = np.uint64
_P, _Q, _R = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates: everything but 0x20 and 0x09 to 0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept for blocks of usual size."""
    size = 1 << max(16, (n - 1).bit_length())
    if (int(base), size) not in _POWERS:
        up, down = np.full(size, base, U64), np.full(size, U64(pow(int(base), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        pair = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n > 8 * BLOCK_BYTES:
            return pair
        _POWERS[int(base), size] = pair
    return _POWERS[int(base), size]


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of values[start:end] for each pair."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


class Block:
    """Words of several texts. text: index of each word's text; first: where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.n_texts, self.raw, self.offsets = len(offsets) - 1, data, offsets
        self.data = LOWER[data] if lower else data
        inside = table[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n_texts), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: np.uint64 = _P) -> np.ndarray:
        """64-bit hashes of the words: eight bytes at a time are mixed in, so words of up to eight never collide with one
        another of their length; words of over LONG bytes by a cryptographic hash."""
        size = self.end - self.start
        h = mix(size.astype(U64) * _R + seed)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        some, at = np.arange(len(size)), self.start
        for k in range(0, min(int(size.max(initial=0)), LONG), 8):
            if k:
                some = some[size[some] > k]
                at = self.start[some] + k
            rest = np.minimum(size[some] - k, 8).astype(U64)
            h[some] = mix(h[some] ^ (lanes[at] & (~U64(0) >> (U64(64) - U64(8) * rest))))
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8, key=int(seed).to_bytes(8, "little")).digest(), "little")
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(values: np.ndarray, k: int, base: np.uint64 = _Q) -> np.ndarray:
    """Hashes of values[i:i + k] for every i that has k values from it on."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return mix(_ranges(values, at, at + k, base) + U64(k))


def whole(values: np.ndarray, first: np.ndarray, base: np.uint64 = _Q) -> np.ndarray:
    """A hash for each of the runs values[first[i]:first[i + 1]], as windows() gives one of that length."""
    return mix(_ranges(values, first[:-1], first[1:], base) + np.diff(first).astype(U64))


def owned(first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the windows of k values that lie in one run; first: where runs begin, and the end."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = int(n.sum())
    return np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(total)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(from, to) of texts, each block of at most so many bytes or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def blocks(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, most: int = BLOCK_BYTES):
    """(from, to, Block) over the texts of a column."""
    data, offsets = texts(column)
    for i, j in pieces(data, offsets, most):
        yield i, j, Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, lower)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the intervals."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
