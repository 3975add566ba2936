"""Vectorised tokens: words, windows and their 64-bit hashes straight from Arrow buffers.

All functions work on the bytes of a slice of texts at once; no Python object
is made per word. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time, so that arrays stay in a core's cache; a longer text is handled alone.
SLICE = 1 << 18
#: Spans up to so many bytes are hashed eight bytes at a time, longer ones all at once.
SHORT = 64
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Keeps the first bytes of eight.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

BYTES = np.arange(256)
#: Separators: space and 0x09 to 0x0D.
SPACES = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
#: Separators: all of ASCII but letters and digits.
NOT_ALNUM = (BYTES < 0x30) | ((BYTES > 0x39) & (BYTES < 0x41)) | ((BYTES > 0x5A) & (BYTES < 0x61)) | ((BYTES > 0x7A) & (BYTES < 0x80))
NEWLINE = BYTES == 0x0A
def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with at most ``limit`` bytes, or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return data | ((data - np.uint8(0x41)) < 26).view(np.uint8) << 5


def apart(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Which bytes are separators."""
    if separators is SPACES:
        return (data == 0x20) | ((data - np.uint8(0x09)) < 5)
    return data == 0x0A if separators is NEWLINE else separators[data]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators, none across texts, and where each text's runs begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart(data, separators)
    change = np.empty(n + 1, bool)
    change[0], change[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    edges = np.flatnonzero(change)  # starts and ends in turn
    inner = offsets[(offsets > 0) & (offsets < n)]
    touching = np.unique(inner[inside[inner - 1] & inside[inner]])
    if len(touching):
        edges = np.sort(np.concatenate([edges, touching, touching]))
    starts = np.ascontiguousarray(edges[::2])
    return starts, np.ascontiguousarray(edges[1::2]), np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _Q)
    left, at = np.flatnonzero(size > 8), 8
    while len(left) and at < SHORT:
        chunk = eight[starts[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]
        out[left] = mix(out[left] * np.uint64(_P) + chunk)
        at += 8
        left = left[size[left] > at]
    if len(left):
        out[left] = mix(out[left] * np.uint64(_P) + _long_hashes(data, starts[left] + at, size[left] - at))
    return out


def _long_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of spans of any length: the sum of their bytes times powers of a constant."""
    first = np.cumsum(size) - size
    n = int(size.sum())
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(max(n + 1, 2 * SLICE), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data[np.arange(n) + np.repeat(starts - first, size)].astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=total[1:])
    return (total[first + size] - total[first]) * _powers[1][first]


def word_hashes(data, offsets, separators=SPACES, fold=True):
    """Hash of every word, where each text's words begin (one longer than the texts), and the spans."""
    if fold:
        data = folded(data)
    starts, ends, begin = spans(data, offsets, separators)
    return hashes(data, starts, ends), begin, starts, ends


def windows(h: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, their first words, and where each text's runs begin."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _Q + h[j : j + n]
    last = np.repeat(begin[1:], np.diff(begin))[:n]  # the end of the text that a word is in
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mix(acc[at]), at, np.searchsorted(at, begin)


def whole(h: np.ndarray) -> np.uint64:
    """A hash of a sequence of words as one, apart from those of windows."""
    acc = 0
    for x in h.tolist():
        acc = (acc * 0x100000001B3 + x) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([acc ^ (len(h) * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For every text, in order, the sorted distinct hashes of its k-word shingles.

    A text with fewer words gives its whole sequence as one shingle; one without words, none.
    """
    for i, j, data, offsets in slices(column):
        h, begin, _, _ = word_hashes(data, offsets)
        w, _, first = windows(h, begin, k)
        for t in range(j - i):
            if first[t + 1] > first[t]:
                yield np.unique(w[first[t] : first[t + 1]])
            elif begin[t + 1] > begin[t]:
                yield np.array([whole(h[begin[t] : begin[t + 1]])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each group begins.

    The low bits of the keys and places in one number sort many times faster than places by key;
    only where two keys agree in those bits alone are they sorted as wholes.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    both = np.sort(keys << bits | np.arange(n, dtype=np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    low, inside = both >> bits, keys[order]
    new, clash = inside[1:] != inside[:-1], low[1:] == low[:-1]
    if (new & clash).any():
        order = np.argsort(keys, kind="stable")
        inside = keys[order]
        new = inside[1:] != inside[:-1]
    return order, np.concatenate(([0], np.flatnonzero(new) + 1))


class Lookup:
    """Positions of 64-bit keys in a table, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.keys, self.slot = np.uint64(size - 1), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            free = self.slot[at] < 0
            spot, who = np.unique(at[free], return_index=True)
            got = left[free][who]
            self.slot[spot], self.keys[spot] = got, keys[got]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[who]] = False
            left, at = left[stay], (at[stay] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key in the table, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            left, at = left[go], (at[go] + np.uint64(1)) & self.mask
        return out


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
