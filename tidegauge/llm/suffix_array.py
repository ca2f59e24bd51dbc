"""Suffix arrays by induced sorting and permuted common prefixes, in numpy, for one shard of text at a time.

Suffixes are larger (L) or smaller (S) than their successor; an S suffix after an L suffix is leftmost (LMS). The strings
between LMS places are sorted by inducing once, named, and, if names repeat, their order comes from the suffix array of the
names. Inducing once more from the sorted LMS suffixes gives the whole array. Entries are induced a run at a time: all
entries up to the first place still open are final, and what they induce follows in their order.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last one is L, as the end is smaller than any symbol."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64), append=-1))
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _put(c: np.ndarray, head: np.ndarray, step: int) -> np.ndarray:
    """Places for symbols ``c`` in order, from the heads of their buckets on, which move."""
    n = len(c)
    if c.dtype.itemsize <= 2:
        order = np.argsort(c, kind="stable")  # by counting
    else:  # symbols and places in one number
        bits = n.bit_length()
        key = (c.astype(np.int64) << bits) | np.arange(n)
        key.sort()
        order = key & ((1 << bits) - 1)
    own = c[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=size[:-1])
    size[-1:] = n - first[-1:]
    out = np.empty(n, np.int64)
    out[order] = head[own] + step * (np.arange(n) - np.repeat(first, size))
    head[own[first]] += step * size
    return out


def _induced(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, induced from the LMS suffixes in the order given."""
    n = len(t)
    large, small, left = (np.bincount(x, minlength=k) for x in (t[~is_s], t[is_s], t[lms]))
    # L suffixes, from the left, in an array of L and LMS suffixes; before them the end, which goes before the last suffix
    start = 1 + np.concatenate([[0], np.cumsum(large + left)[:-1]])
    a = np.full(1 + len(lms) + int(large.sum()), -1, np.int64)
    a[0] = n
    a[_put(t[lms], start + large, 1)] = lms
    head, at, width = start.copy(), 0, 64
    while at < len(a):
        to = at
        while True:
            open_ = a[to : to + width] < 0
            i = int(open_.argmax())
            if open_[i]:
                to += i
                break
            to += len(open_)
            if to >= len(a):
                break
        before = a[at:to] - 1
        before = before[before >= 0]
        before = before[~is_s[before]]
        if len(before):
            a[_put(t[before], head, 1)] = before
        width = max(64, 2 * (to - at))
        at = to
    # S suffixes, from the right
    place = np.concatenate([[0], np.cumsum(large + small)])
    out = np.full(n, -1, np.int64)
    own = a[a < n]
    own = own[~is_s[own]]
    out[_put(t[own], place[:-1].copy(), 1)] = own
    tail, at, width = place[1:] - 1, n, 64
    while at > 0:
        to = at
        while True:
            low = max(0, to - width)
            open_ = out[low:to][::-1] < 0
            i = int(open_.argmax())
            if open_[i]:
                to -= i
                break
            to = low
            if to <= 0:
                break
        before = out[to:at][::-1] - 1
        before = before[before >= 0]
        before = before[is_s[before]]
        if len(before):
            out[_put(t[before], tail, -1)] = before
        width = max(64, 2 * (at - to))
        at = to
    return out


def _names(t: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of LMS strings in their sorted order: one more where a string differs from the one before. ``length`` by place."""
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        at = at[length[a[at]] > k]
        equal = t[a[at] + k] == t[b[at] + k]
        same[at[~equal]] = False
        at = at[equal]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Places of all suffixes of ``t`` (symbols from 0 to k - 1) in their order; a suffix that another one starts with is smaller."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    k = int(t.max()) + 1 if k is None else k
    t = t.astype(np.uint8 if k <= 1 << 8 else np.uint16 if k <= 1 << 16 else np.int64)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        found = _induced(t, is_s, lms, k)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = found[is_lms[found]]
        # a string ends with the next LMS symbol; the last one with the end, which makes it a string of its own
        length = np.zeros(n, np.int64)
        length[lms] = np.diff(lms, append=n) + 1
        length[lms[-1]] = -1
        name = _names(t, order, length)
        if name[-1] + 1 < len(lms):
            by_place = np.empty(n, np.int64)
            by_place[order] = name
            order = lms[suffix_array(by_place[lms], int(name[-1]) + 1)]
        lms = order
    return _induced(t, is_s, lms, k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place: the common prefix of its suffix and the one before it in order.

    Where both suffixes follow the same symbol, it is one less than at the place before; only the other places are compared."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    inner = (at > 0) & (before > 0)
    reducible = inner.copy()
    reducible[inner] = (t[at[inner] - 1] == t[before[inner] - 1]) & (before[at[inner] - 1] == before[inner] - 1)
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(1, np.int64)])
    while len(todo):
        a, b = todo + out[todo], before[todo] + out[todo]
        go = (a < n) & (b < n)
        go &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        todo = todo[go]
        out[todo] += 1
    from_ = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, out[from_] - (at - from_), out)
