"""Signature trees over token sets, and their dual traversal.

A leaf holds a few sets; every node has the OR of its sets' bitmaps, the range of their sizes and the most collisions
(tokens beyond the bits set) of any of them. Two sets below a pair of nodes share at most the common bits plus the
smaller allowance for collisions; where that, or the ranges of sizes, cannot reach the threshold, the pair is pruned.
"""

from __future__ import annotations

import numpy as np

LEAF = 4


def needed(size: np.ndarray | int, per: int):
    """Least overlap of a set of this size with any partner: ceil(size * per / 100)."""
    return -(-(size * per) // 100)


def linked(x: np.ndarray, y: np.ndarray, per: int) -> bool:
    """Whether 100 * intersection >= per * union, for sorted distinct tokens."""
    a, b = len(x), len(y)
    if not a or not b or 100 * min(a, b) < per * max(a, b):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= per * (a + b - common)


class Forest:
    """Union-find over numbered sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("bits", "excess", "kids", "most", "least", "sets", "one")

    def __init__(self, sets: list[int], kids: list["Node"], bits: np.ndarray, least: int, most: int, excess: int):
        self.sets, self.kids, self.bits, self.least, self.most, self.excess = sets, kids, bits, least, most, excess
        self.one = False  # all sets below are known to be in one component


def tree(sets: list[np.ndarray], order: list[int], words: int) -> Node:
    """A tree over sets in this order; bitmaps of ``words`` 64-bit words."""
    nodes = []
    for i in range(0, len(order), LEAF):
        own = order[i : i + LEAF]
        bits, excess = np.zeros(words * 64, bool), 0
        for s in own:
            one = np.unique(sets[s] % np.uint64(words * 64)).astype(np.int64)
            bits[one] = True
            excess = max(excess, len(sets[s]) - len(one))
        sizes = [len(sets[s]) for s in own]
        nodes.append(Node(own, [], np.packbits(bits).view(np.uint64), min(sizes), max(sizes), excess))
    while len(nodes) > 1:
        pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        nodes = [p[0] if len(p) == 1 else Node([], p, p[0].bits | p[1].bits, min(x.least for x in p), max(x.most for x in p), max(x.excess for x in p)) for p in pairs]
    return nodes[0]


def _may(a: Node, b: Node, per: int) -> bool:
    if 100 * min(a.most, b.most) < per * max(a.least, b.least):
        return False
    # the overlap of a linked pair is at least per / (100 + per) of both sizes together
    least = -(-(per * (a.least + b.least)) // (100 + per))
    return int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess) >= least


def _first(node: Node) -> int:
    while node.kids:
        node = node.kids[0]
    return node.sets[0]


def _settle(node: Node, forest: Forest) -> None:
    if not node.one:
        roots = {forest.root(s) for s in node.sets} if not node.kids else {forest.root(_first(k)) for k in node.kids} if all(k.one for k in node.kids) else {0, 1}
        node.one = len(roots) == 1


def join(a: Node, b: Node, sets: list[np.ndarray], per: int, forest: Forest) -> None:
    """Join in ``forest`` all linked pairs with one set below each node, but for those already joined."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        if a is None:  # all below b is done
            _settle(b, forest)
            continue
        if a is b:
            if a.kids:
                work += [(None, a), (a.kids[0], a.kids[1]), (a.kids[1], a.kids[1]), (a.kids[0], a.kids[0])]
            else:
                for i, x in enumerate(a.sets):
                    for y in a.sets[i + 1 :]:
                        if forest.root(x) != forest.root(y) and linked(sets[x], sets[y], per):
                            forest.join(x, y)
                _settle(a, forest)
            continue
        if a.one and b.one and forest.root(_first(a)) == forest.root(_first(b)) or not _may(a, b, per):
            continue
        if a.kids and (not b.kids or len(a.kids) and a.most - a.least >= b.most - b.least):
            work += [(k, b) for k in reversed(a.kids)]
        elif b.kids:
            work += [(a, k) for k in reversed(b.kids)]
        else:
            for x in a.sets:
                for y in b.sets:
                    if forest.root(x) != forest.root(y) and linked(sets[x], sets[y], per):
                        forest.join(x, y)


def bitmap_words(sets: list[np.ndarray]) -> int:
    """About eight bits for each token of the larger sets, as a power of two."""
    size = max(64, int(np.quantile([len(s) for s in sets], 0.9)))
    return 1 << max(3, min(13, int(np.ceil(np.log2(size * 8 / 64)))))


def link_all(sets: list[np.ndarray], per: int, split: int | None = None) -> list[int]:
    """Component of each set (its smallest member): of all pairs, or, given ``split``, those on either side of it too
    (sets before and after are then separate trees; pairs inside either are joined as well)."""
    forest = Forest(len(sets))
    words = bitmap_words(sets)

    def ordered(of: range) -> list[int]:
        # sets that are alike come together: by size class, then smallest token
        return sorted(of, key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))

    if split is None or split in (0, len(sets)):
        root = tree(sets, ordered(range(len(sets))), words)
        join(root, root, sets, per, forest)
    else:
        a, b = tree(sets, ordered(range(split)), words), tree(sets, ordered(range(split, len(sets))), words)
        join(a, a, sets, per, forest)
        join(b, b, sets, per, forest)
        join(a, b, sets, per, forest)
    return [forest.root(i) for i in range(len(sets))]
