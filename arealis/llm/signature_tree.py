"""Signature trees: sets as folded token bitmaps, searched in pairs of nodes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Two sets link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 75, 100
#: Bits of the longest bitmap; those of larger sets say less, but never too little.
WIDEST = 1 << 17
LEAF = 8


@dataclass(frozen=True)
class Sketch:
    """A set by its size and the bitmap of its tokens modulo ``width`` (a power of two)."""

    name: int
    size: int
    width: int
    bits: int


def width_of(size: int) -> int:
    """Four to eight bits for a token."""
    return min(WIDEST, 1 << max(6, (4 * size - 1).bit_length()))


def bitmap(tokens: np.ndarray) -> bytes:
    """The bitmap of a set of 64-bit tokens, lowest bit first."""
    flags = np.zeros(width_of(len(tokens)), dtype=bool)
    flags[(tokens & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def at_most(either_a: int, every_a: int, low_a: int, high_a: int, either_b: int, every_b: int, low_b: int, high_b: int) -> bool:
    """Whether some pair below two nodes can overlap enough.

    A bit that all sets of one node have and no set of the other is a token that no
    intersection has; sizes too far apart never link.
    """
    if high_a * DEN < NUM * low_b or high_b * DEN < NUM * low_a:
        return False
    most = min(high_a - (every_a & ~either_b).bit_count(), high_b - (every_b & ~either_a).bit_count())
    return most * (NUM + DEN) >= NUM * (low_a + low_b)


def looks_linked(x: int, a: int, y: int, b: int, width: int, margin: float) -> bool:
    """Whether two sets are linked by their bitmaps' estimate, ``margin`` above the limit and more for small sets."""
    clear_x, clear_y = 1 - x.bit_count() / width, 1 - y.bit_count() / width
    common = min(a - (x & ~y).bit_count() / max(clear_y, 0.01), b - (y & ~x).bit_count() / max(clear_x, 0.01))
    return common >= (NUM / DEN + margin + 0.15 / max(a, b) ** 0.5) * (a + b - common)


class Tree:
    """Sets with like bitmaps side by side; a node has OR and AND of its bitmaps and its range of sizes."""

    def __init__(self, sets: list[Sketch], width: int):
        self.width = width
        maps = [folded(s.bits, s.width, width) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: (_lowest(maps[i]), sets[i].size))
        self.sets, self.maps = [sets[i] for i in order], [maps[i] for i in order]
        self.root = self._node(0, len(order))

    def _node(self, lo: int, hi: int) -> list:
        """``[lo, hi, OR, AND, least size, largest size, children, a name if all are known to be connected]``."""
        if hi - lo <= LEAF:
            either, every = 0, -1
            for x in self.maps[lo:hi]:
                either, every = either | x, every & x
            sizes = [s.size for s in self.sets[lo:hi]]
            return [lo, hi, either, every, min(sizes), max(sizes), (), None]
        a, b = self._node(lo, (lo + hi) // 2), self._node((lo + hi) // 2, hi)
        return [lo, hi, a[2] | b[2], a[3] & b[3], min(a[4], b[4]), max(a[5], b[5]), (a, b), None]


def _lowest(x: int, n: int = 3) -> tuple[int, ...]:
    """Places of the lowest bits: near copies mostly agree in them."""
    out = []
    while x and len(out) < n:
        low = x & -x
        out.append(low.bit_length())
        x ^= low
    return tuple(out)


def _traverse(s: Tree, t: Tree, find: Callable[[int], int]) -> Iterator[tuple[int, int]]:
    """Places of pairs that can link and that ``find`` doesn't know to be connected; one tree may be both."""

    def one_root(tree: Tree, node: list) -> int | None:
        """The root of all that a node holds, if it is one; once it is, it stays so."""
        if node[7] is None:
            roots = {one_root(tree, c) for c in node[6]} if node[6] else {find(x.name) for x in tree.sets[node[0] : node[1]]}
            if len(roots) > 1 or None in roots:
                return None
            node[7] = roots.pop()
        return find(node[7])

    todo = [(s.root, t.root)]
    while todo:
        p, q = todo.pop()
        if not at_most(p[2], p[3], p[4], p[5], q[2], q[3], q[4], q[5]):
            continue
        root = one_root(s, p)
        if root is not None and (p is q or root == one_root(t, q)):
            continue
        if p[6] or q[6]:
            if p is q:
                a, b = p[6]
                todo += [(a, b), (b, b), (a, a)]
            elif p[6] and (not q[6] or p[1] - p[0] >= q[1] - q[0]):
                todo += [(x, q) for x in p[6]]
            else:
                todo += [(p, x) for x in q[6]]
            continue
        for i in range(p[0], p[1]):
            x, a = s.maps[i], s.sets[i].size
            for j in range(i + 1 if p is q else q[0], q[1]):
                y, b = t.maps[j], t.sets[j].size
                if find(s.sets[i].name) != find(t.sets[j].name) and at_most(x, x, a, a, y, y, b, b):
                    yield i, j


def possible_links(sets: list[Sketch], others: list[Sketch] | None = None, connected: dict[int, int] | None = None, margin: float | None = 0.02) -> list[tuple[int, int, bool]]:
    """``(name, name, trusted)``: pairs that may link, among ``sets`` or between them and ``others``.

    ``connected`` gives names that are known to be connected the same one of them. Pairs that their
    bitmaps put ``margin`` above the limit are trusted: what they connect is looked at no
    further, so a group of near copies gives about as many pairs as it has members. All
    other pairs that could link by their bitmaps' bound and that trusted ones don't
    connect are given; with ``margin`` None all pairs that ``connected`` leaves open.
    """
    known, parent = connected or {}, {}

    def find(x: int) -> int:
        x = known.get(x, x)
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []

    def take(s: Tree, t: Tree) -> None:
        for i, j in _traverse(s, t, find):
            u, v = s.sets[i], t.sets[j]
            sure = margin is not None and looks_linked(s.maps[i], u.size, t.maps[j], v.size, s.width, margin)
            out.append((u.name, v.name, sure))
            if sure:
                parent[find(u.name)] = find(v.name)

    def by_width(group: list[Sketch]) -> dict[int, list[Sketch]]:
        found = defaultdict(list)
        for x in group:
            found[x.width].append(x)
        return found

    left, right = by_width(sets), by_width(others) if others is not None else None
    for w, mine in sorted(left.items()):
        tree = Tree(mine, w)
        if right is None:
            take(tree, tree)
            if 2 * w in left:  # sets that can link have widths at most one step apart
                take(tree, Tree(left[2 * w], w))
            continue
        for v in (w // 2, w, 2 * w):
            if v in right:
                low = min(v, w)
                take(tree if low == w else Tree(mine, low), Tree(right[v], low))
    return [x for x in out if x[2] or find(x[0]) != find(x[1])]
