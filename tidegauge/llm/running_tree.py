"""Context-tree weighting over running text, in parts that no task need hold whole.

Nodes and estimates are those of ``context_tree``; contexts are the DEPTH bytes before a byte, across words, with START
before a text. A code holds them newest first, then the byte, so that a sorted run of codes is a subtree. Subtrees below
some context bytes (``top`` of them) are dealt out by those bytes; the nodes above are few and are weighted in one place. Codes that
were only asked for have count 0: they change no estimate and take the chance of the deepest node that has counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .context_tree import DEPTH, START, TEXT_END, WORD_END, counted, log_kt
from .words import U, Block, mix

#: Places of a unit that are worked on together, more or less.
PART_PLACES = 1 << 20
_CHANGE = np.asarray([*(i.bit_length() for i in range(256)), 9], np.uint8)
#: Sums of weights are kept in whole steps, so that their order does not matter.
STEPS = float(1 << 20)


def stream(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block as coded, each after DEPTH times START: words, each with its separator, and the text's end. Also bytes coded per row."""
    length = b.end - b.start
    row = b.row_of_word()
    size = np.bincount(row, length + 1, len(b.first) - 1).astype(np.int64) + 1
    row_at = np.cumsum(size + DEPTH) - size - DEPTH
    out = np.full(int((size + DEPTH).sum()), WORD_END, np.uint8)
    out[(row_at[:, None] + np.arange(DEPTH)).ravel()] = START
    out[row_at + DEPTH + size - 1] = TEXT_END
    before = np.cumsum(length) - length
    word_at = np.cumsum(length + 1) - length - 1
    at = row_at[row] + DEPTH + word_at - (word_at[np.minimum(b.first[:-1], max(len(row) - 1, 0))][row] if len(row) else 0)
    n = int(length.sum())
    out[np.arange(n) + np.repeat(at - before, length)] = b.data[np.arange(n) + np.repeat(b.start - before, length)]
    return out, size


def unit_parts(coded: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, Entries]]:
    """The coded bytes of a unit by ranges of the byte before them, in order: the row of each, and their codes."""
    n = len(coded)
    back = np.zeros(n + 8, np.uint8)
    back[:n] = coded[::-1]
    # eight bytes read backwards from the one before each place, newest first; the last of them gives way to the byte itself
    before = np.ndarray((n,), np.dtype(">u8"), back, 1, (1,))[::-1]
    newest = np.empty(n, np.int16)
    newest[1:] = coded[:-1]
    at = np.cumsum(size + DEPTH) - size - DEPTH
    newest[(at[:, None] + np.arange(DEPTH)).ravel()] = 256
    row = np.repeat(np.arange(len(size), dtype=np.int32), size + DEPTH)
    upto = np.cumsum(np.bincount(newest, minlength=257)[:256])
    low = 0
    while low < 256 and (low == 0 or upto[low - 1] < upto[-1]):
        high = max(low, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PART_PLACES, "right")) - 1)
        place = np.flatnonzero((newest >= low) & (newest <= min(high, 255)))
        if len(place):
            code = before[place].astype(U)
            code &= ~U(255)
            code |= coded[place]
            yield row[place], Entries(code)
        low = high + 1


class Entries:
    """Distinct codes, sorted, and the places that have each. A code may be listed twice; that does no harm."""

    def __init__(self, code: np.ndarray):
        # sorted as numbers of a hash's first bits and the place: codes that are equal come together
        bits = max(20, len(code).bit_length())
        key, step = code.copy(), np.empty_like(code)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(key, U(shift), out=step)
            key ^= step
            key *= U(factor)
        del step
        key &= ~U((1 << bits) - 1)
        key |= np.arange(len(code), dtype=U)
        key.sort()
        key &= U((1 << bits) - 1)
        self.place = key.astype(np.uint32 if bits <= 32 else np.int64)
        del key
        own = code[self.place]
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        self.head = np.flatnonzero(new)
        own = own[self.head]
        self.order = np.argsort(own)
        self.code = own[self.order]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per code: the sum of x over the places that have it."""
        return np.add.reduceat(x[self.place], self.head, dtype=np.int64)[self.order]

    def per_row(self, price: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Sums over rows of what the codes at their places are priced at."""
        own = np.empty(len(price))
        own[self.order] = price
        return np.bincount(row[self.place], np.repeat(own, np.diff(np.append(self.head, len(self.place)))), rows)


def bucket_of(code: np.ndarray, buckets: int, top: int) -> np.ndarray:
    return (mix(code >> U(64 - 8 * top)) % U(buckets)).astype(np.int64)


class Subtrees:
    """Subtrees from ``top`` context bytes on, over all codes below some of those contexts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, top: int):
        self.top = top
        self.key, self.n, self.up = {DEPTH: code}, {DEPTH: n}, {}
        for d in range(DEPTH, top, -1):
            k = self.key[d]
            self.key[d - 1], self.up[d] = np.unique(((k >> U(16)) << U(8)) | (k & U(255)), return_inverse=True)
            self.n[d - 1] = np.bincount(self.up[d], self.n[d], len(self.key[d - 1])).astype(np.int64)
        # the byte of each key, and in how many of its bits it may differ from the one before it: 9 where the context does
        self.byte = {d: (k & U(255)).astype(np.uint8) for d, k in self.key.items()}
        self.change = {d: np.concatenate([np.full(1, 9, np.uint8), _CHANGE[np.minimum(k[1:] ^ k[:-1], U(256)).astype(np.int16)]]) for d, k in self.key.items()}

    def _bit(self, j: int):
        """Per depth, of the nodes with j leading bits: first row, node of each row, zeros, ones, parent; and weights and shares."""
        head, node, zeros, ones, above, weight, share = {}, {}, {}, {}, {}, {}, {}
        for d in range(self.top, DEPTH + 1):
            n = self.n[d]
            new = self.change[d] > 8 - j
            head[d], node[d] = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            total = np.add.reduceat(n, head[d])
            ones[d] = np.add.reduceat(np.where(self.byte[d] & np.uint8(1 << (7 - j)), n, 0), head[d])
            zeros[d] = total - ones[d]
            if d > self.top:
                above[d] = node[d - 1][self.up[d][head[d]]]
        for d in range(DEPTH, self.top - 1, -1):
            own = log_kt(zeros[d], ones[d])
            if d == DEPTH:
                weight[d], share[d] = own, np.ones(len(own))
            else:
                more = np.bincount(above[d + 1], weight[d + 1], len(own)) - own
                e = np.exp(-np.abs(more))
                weight[d] = own + np.maximum(more, 0) + np.log((1 + e) / 2)
                share[d] = np.where(more > 0, e, 1.0) / (1 + e)
        k = self.key[self.top][head[self.top]]
        parent = ((k >> U(16)) << U(8)) | U(1 << j) | ((k & U(255)) >> U(8 - j))
        return head, node, zeros, ones, above, weight, share, parent

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes one byte above: keys, zeros, ones, and their children's weights in STEPS."""
        found = []
        for j in range(8):
            _, _, zeros, ones, _, weight, _, parent = self._bit(j)
            k, at = np.unique(parent, return_inverse=True)
            found.append((k, *(np.bincount(at, x, len(k)).astype(np.int64) for x in (zeros[self.top], ones[self.top], np.rint(weight[self.top] * STEPS)))))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def log2(self, above_all: Top) -> np.ndarray:
        """log2 of the chance of each code's byte after its context."""
        out = np.zeros(len(self.key[DEPTH]))
        for j in range(8):
            _, node, zeros, ones, above, _, share, parent = self._bit(j)
            at = np.searchsorted(above_all.key, parent)
            mass, sure, chance = above_all.mass[at], above_all.sure[at], above_all.chance[at]
            for d in range(self.top, DEPTH + 1):
                if d > self.top:
                    mass, sure, chance = mass[above[d]], sure[above[d]], chance[above[d]]
                total = zeros[d] + ones[d]
                kt = (ones[d] + 0.5) / (total + 1.0)
                chance = np.where(total > 0, sure + mass * kt, chance)
                mass, sure = mass * (1 - share[d]), sure + mass * share[d] * kt
            p = chance[node[DEPTH]]
            out += np.log2(np.where((self.key[DEPTH] >> U(7 - j)) & U(1) == 1, p, 1 - p))
        return out


class Top:
    """The nodes above: belief left to deeper nodes, chance already sure, and chance where the path ends, at ``top`` - 1 bytes."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int):
        order = np.argsort(key)
        keys, z, o, deep = [key[order]], [zeros[order]], [ones[order]], below[order] / STEPS
        above, share = [], []
        for d in range(top - 1, -1, -1):
            own = log_kt(z[-1], o[-1])
            both = np.logaddexp(own, deep)
            share.append(np.exp(own - both))
            if d:
                up, at = np.unique(((keys[-1] >> U(16)) << U(8)) | (keys[-1] & U(255)), return_inverse=True)
                above.append(at)
                deep = np.bincount(at, both - np.log(2), len(up))
                z.append(np.bincount(at, z[-1], len(up)).astype(np.int64))
                o.append(np.bincount(at, o[-1], len(up)).astype(np.int64))
                keys.append(up)
        mass, sure, chance = np.ones(len(keys[-1])), np.zeros(len(keys[-1])), np.full(len(keys[-1]), 0.5)
        for i in range(top - 1, -1, -1):
            if i < top - 1:
                mass, sure, chance = mass[above[i]], sure[above[i]], chance[above[i]]
            total = z[i] + o[i]
            kt = (o[i] + 0.5) / (total + 1.0)
            chance = np.where(total > 0, sure + mass * kt, chance)
            mass, sure = mass * (1 - share[i]), sure + mass * share[i] * kt
        self.key, self.mass, self.sure, self.chance = keys[0], mass, sure, chance


def runs(code: np.ndarray, most: int, top: int) -> Iterator[slice]:
    """Whole subtrees of sorted codes, some at a time: at most so many codes, or one subtree."""
    lead = code >> U(64 - 8 * top)
    heads = np.append(np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])), len(code)) if len(code) else np.zeros(1, np.int64)
    a = 0
    while a < len(heads) - 1:
        b = max(a + 1, int(np.searchsorted(heads, heads[a] + most, "right")) - 1)
        yield slice(int(heads[a]), int(heads[b]))
        a = b


def merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, their counts, and the place of each code given."""
    every = np.sort(code)
    found = every[np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]])]
    at = np.searchsorted(found, code)
    return found, np.bincount(at, n, len(found)).astype(np.int64), at


def total_sums(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums of several runs by key."""
    key, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (counted(key, values[0])[0], *(counted(key, v)[1] for v in values))
