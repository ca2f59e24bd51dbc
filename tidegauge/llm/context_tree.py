"""Context-tree weighting over bytes, each byte taken as eight binary decisions.

A node is a context (the last d bytes, d up to DEPTH, reaching back to the start of the word at most) and the leading
bits of the byte. Its Krichevsky-Trofimov estimate and the product of its children's weighted probabilities are mixed
half and half; with the counts fixed, the mixture gives each node a share of belief against all deeper ones, and the
chance of a bit is the sum over the path of share times estimate.

A word is coded as its bytes and one separator byte; the end of a text is a byte of its own. Codes of grams hold the
context's bytes, oldest first, then the byte, in 64 bits; START stands before a word's first byte.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
DEPTH = 7
START, WORD_END, TEXT_END = 0, 0x20, 0x0A


def position_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words data[start:end], each with its separator: gram code with DEPTH context bytes (START beyond the word's
    start), depth of the longest context, and number of the word, for each byte coded."""
    length = (end - start) + 1
    first = np.cumsum(length) - length
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(int(length.sum())) - first[word]
    own = np.full(len(place), WORD_END, np.uint8)
    inside = place < length[word] - 1
    own[inside] = data[start[word[inside]] + place[inside]]
    code = own.astype(U)
    for i in range(1, DEPTH + 1):
        back = np.zeros(len(own), U)
        back[i:] = own[:-i]
        code |= np.where(place >= i, back, U(START)) << U(8 * i)
    return code, np.minimum(place + 1, DEPTH).astype(np.int8), word


def counted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of n."""
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[at], np.add.reduceat(n, at)


def _cut(code: np.ndarray, depth: int) -> np.ndarray:
    return code & U((1 << (8 * (depth + 1))) - 1) if depth < 7 else code


def depth_tables(code: np.ndarray, depth: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of (context, byte) at every depth from those at each position's longest context."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    up, up_n = np.zeros(0, U), np.zeros(0, np.int64)
    for d in range(DEPTH, -1, -1):
        own = depth == d
        up, up_n = counted(np.concatenate([_cut(up, d), _cut(code[own], d)]), np.concatenate([up_n, n[own]]))
        out.append((up, up_n))
    return out[::-1]


_GRID = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4096) + 0.5))])
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def _log_rising_half(n: np.ndarray) -> np.ndarray:
    """log of Gamma(n + 1/2) / Gamma(1/2)."""
    x = n + 0.5
    far = x * np.log(x) - x - 0.5 * np.log(x) + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 0.5 * np.log(np.pi)
    return np.where(n < 4096, _GRID[np.minimum(n, 4096).astype(np.int64)], far)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    far = x * np.log(x) - x - 0.5 * np.log(x) + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return np.where(n < 4096, _FACT[np.minimum(n, 4096).astype(np.int64)], far)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_rising_half(zeros) + _log_rising_half(ones) - _log_factorial(zeros + ones)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same, mostly from tables."""
    total = zeros + ones
    small = total < 4096
    z, o, t = (x if small.all() else np.where(small, x, 0) for x in (zeros, ones, total))
    out = _GRID[z] + _GRID[o] - _FACT[t]
    if not small.all():
        out[~small] = _kt(zeros[~small], ones[~small])
    return out


class ContextTree:
    """Per depth: sorted node keys (context * 256 + leading bits after a 1) and the chance of a one where the path ends there."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        keys, zeros, ones = [], [], []
        for code, n in tables:
            byte, context = (code & U(255)).astype(np.int64), code >> U(8)
            node, bit, count = [], [], []
            for j in range(8):
                node.append(_node(context, (1 << j) | (byte >> (8 - j))))
                bit.append((byte >> (7 - j)) & 1)
                count.append(n)
            node, bit, count = np.concatenate(node), np.concatenate(bit), np.concatenate(count)
            k, ends = counted(node, count)
            k1, n1 = counted(node[bit == 1], count[bit == 1])
            one = np.zeros(len(k), np.int64)
            one[np.searchsorted(k, k1)] = n1
            keys.append(k)
            ones.append(one)
            zeros.append(ends - one)
        share = [np.ones(len(k)) for k in keys]
        above: list[np.ndarray] = [np.zeros(0, np.int64)]
        for d in range(1, len(keys)):
            above.append(np.searchsorted(keys[d - 1], _node(_context(keys[d]) & U((1 << (8 * (d - 1))) - 1), _bits(keys[d]))))
        weighted: list[np.ndarray] = [np.zeros(0)] * len(keys)
        for d in range(len(keys) - 1, -1, -1):
            own = _kt(zeros[d], ones[d])
            if d + 1 < len(keys) and len(keys[d + 1]):
                up = above[d + 1]
                rest0 = zeros[d] - np.bincount(up, zeros[d + 1], len(own)).astype(np.int64)
                rest1 = ones[d] - np.bincount(up, ones[d + 1], len(own)).astype(np.int64)
                deep = np.bincount(up, weighted[d + 1], len(own)) + _kt(np.maximum(rest0, 0), np.maximum(rest1, 0))
                has = np.bincount(up, minlength=len(own)) > 0
                both = np.logaddexp(own, deep)
                share[d] = np.where(has, np.exp(own - both), 1.0)
                weighted[d] = np.where(has, both - np.log(2), own)
            else:
                weighted[d] = own
        self.keys, self.chance = keys, []
        mass, sure = np.ones(len(keys[0])), np.zeros(len(keys[0]))
        for d in range(len(keys)):
            if d:
                mass, sure = mass[above[d]], sure[above[d]]
            kt = (ones[d] + 0.5) / (ones[d] + zeros[d] + 1.0)
            self.chance.append((sure + mass * kt).astype(np.float32))
            mass, sure = mass * (1 - share[d]), sure + mass * share[d] * kt

    def log2(self, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's byte after its context; depth: of the longest context to be used."""
        out = np.zeros(len(code))
        byte, context = (code & U(255)).astype(np.int64), code >> U(8)
        for j in range(8):
            p, todo = np.full(len(code), 0.5), np.arange(len(code))
            lead = (1 << j) | (byte >> (8 - j))
            for d in range(len(self.keys) - 1, -1, -1):
                if not len(self.keys[d]) or not len(todo):
                    continue
                own = todo[depth[todo] >= d]
                want = _node(context[own] & U((1 << (8 * d)) - 1), lead[own])
                at = np.minimum(np.searchsorted(self.keys[d], want), len(self.keys[d]) - 1)
                hit = self.keys[d][at] == want
                p[own[hit]] = self.chance[d][at[hit]]
                left = np.ones(len(code), bool)
                left[own[hit]] = False
                todo = todo[left[todo]]
            out += np.log2(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
        return out


def _node(context: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (context << U(8)) | bits.astype(U)


def _context(node: np.ndarray) -> np.ndarray:
    return node >> U(8)


def _bits(node: np.ndarray) -> np.ndarray:
    return node & U(255)
