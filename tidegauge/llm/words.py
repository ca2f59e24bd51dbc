"""Words and hashes of whole texts, a block of Arrow rows at a time, in numpy.

A word is a run of bytes outside ``[ \\t-\\r]`` (0x20, 0x09-0x0D); A-Z are lower-cased. In UTF-8 those bytes
occur only as themselves, so cutting bytes cuts characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(_BASE)
_BACK = U(pow(_BASE, -1, 2**64))
#: Bytes of text worked on at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later tasks, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U)


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the places that have it."""
    order = np.argsort(keys, kind="stable")
    found, at = np.unique(keys[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, at[1:]) if len(found) else [], strict=True)


@dataclass
class Block:
    """Words of consecutive rows: word i is ``data[start[i]:end[i]]``; row r has words ``first[r]:first[r+1]``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U)
            np.cumsum(_LETTER[self.data] * _powers(_STEP, n), out=total[1:])
            own = (total[self.end] - total[self.start]) * _powers(_BACK, n + 1)[self.start]
            return mix(own + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def row_runs(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes (or one row)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = True, separator: np.ndarray = SEPARATOR) -> Iterator[Block]:
    """The words of a string column, in blocks of whole rows. separator: which bytes are not in words."""
    data, offsets = text_buffers(column)
    for a, b in row_runs(offsets):
        own = data[offsets[a] : offsets[b]]
        own = LOWER[own] if lower else own
        cut = offsets[a : b + 1] - offsets[a]
        word = ~separator[own]
        begins, ends = word.copy(), word.copy()
        if len(own):
            begins[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            at = cut[:-1][cut[:-1] < len(own)]
            begins[at] = word[at]
            at = cut[1:][cut[1:] > 0] - 1
            ends[at] = word[at]
        start = np.flatnonzero(begins)
        yield Block(slice(a, b), own, cut, start, np.flatnonzero(ends) + 1, np.searchsorted(start, cut))


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; a shorter text is one shingle, an empty one none."""
    if not len(word):
        return word
    with np.errstate(over="ignore"):
        if len(word) < k:
            out = U(len(word))
            for x in word:
                out = mix(np.asarray(out * U(0x2545F4914F6CDD1D) + x))
            return np.asarray([out], U)
        out = np.zeros(len(word) - k + 1, U)
        for i in range(k):
            out = out * U(0x2545F4914F6CDD1D) + word[i : len(word) - k + 1 + i]
        return mix(out)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, which compress well."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    """``n`` numbers of ``packed``."""
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()
