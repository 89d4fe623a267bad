"""Signature trees over the bitmaps of a group of sets, and their dual traversal."""

from __future__ import annotations

FAN = 8


def fold(bits: int, width: int, to: int) -> int:
    """A bitmap of ``width`` bits (a power of two) folded to ``to`` bits by OR-ing its halves."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    """Sets below: the OR of their bitmaps, the range of their sizes, the most elements that share bits, and their common class if they have one."""

    __slots__ = ("bits", "children", "least", "most", "shared", "group", "width")

    def __init__(self, children: list):
        self.children = children
        self.width = min(c.width for c in children)
        self.bits = 0
        for c in children:
            self.bits |= fold(c.bits, c.width, self.width)
        self.least, self.most = min(c.least for c in children), max(c.most for c in children)
        # folding can only join bits: recount what elements share at this width
        self.shared = max(c.shared if c.width == self.width else c.most - min(c.most, fold(c.bits, c.width, self.width).bit_count()) if isinstance(c, Leaf) else c.most for c in children)
        self.group = children[0].group if all(c.group is not None and c.group == children[0].group for c in children) else None


class Leaf:
    __slots__ = ("bits", "group", "item", "least", "most", "shared", "width")

    def __init__(self, item: int, size: int, bits: int, width: int, group):
        self.item, self.least, self.most, self.bits, self.width, self.group = item, size, size, bits, width, group
        self.shared = size - bits.bit_count()


def build(leaves: list[Leaf]) -> Node | Leaf:
    """Sets of like sizes lie together, and of like bitmaps within a size."""
    level: list = sorted(leaves, key=lambda x: (x.width, x.least, x.bits))
    while len(level) > 1:
        level = [Node(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def most_overlap(a, b) -> int:
    """No set of ``a`` and set of ``b`` have more elements in common."""
    width = min(a.width, b.width)
    x, y = fold(a.bits, a.width, width), fold(b.bits, b.width, width)
    common = (x & y).bit_count()
    if isinstance(a, Leaf) and isinstance(b, Leaf):
        return min(a.most - x.bit_count(), b.most - y.bit_count()) + common
    if width == a.width == b.width:
        return min(min(a.shared, b.shared) + common, a.most, b.most)
    return min(a.most, b.most)


def may_link(a, b, percent: int) -> bool:
    """False if no pair below reaches the similarity: by the ranges of sizes, then by the overlap it would need."""
    if 100 * b.most < percent * a.least or 100 * a.most < percent * b.least:
        return False
    if a.group is not None and a.group == b.group:
        return False
    need = -(-percent * (a.least + b.least) // (100 + percent))
    return most_overlap(a, b) >= need


def candidates(leaves: list[Leaf], percent: int, others: list[Leaf] | None = None) -> list[tuple[int, int, int]]:
    """(overlap bound, item, item) of all pairs of different groups that may reach the similarity, by dual traversal of one tree with itself or with that of ``others``."""
    found = []
    root = build(leaves)
    stack = [(root, root if others is None else build(others))]
    while stack:
        a, b = stack.pop()
        if isinstance(a, Leaf) and isinstance(b, Leaf):
            if a is not b and may_link(a, b, percent):
                found.append((most_overlap(a, b), a.item, b.item))
        elif a is b:
            if a.group is None:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
        elif may_link(a, b, percent):
            if isinstance(b, Leaf) or (not isinstance(a, Leaf) and a.most - a.least >= b.most - b.least):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, y) for y in b.children]
    return found


def forest(pairs: list[tuple[int, int, int]], names: list[int]) -> list[tuple[int, int]]:
    """The pairs of a spanning forest that takes the highest bounds first, then the least ``names``: groups that share sets
    choose the same pairs."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], min(names[p[1]], names[p[2]]), max(names[p[1]], names[p[2]]))):
        if (x := top(a)) != (y := top(b)):
            parent[x] = y
            kept.append((a, b))
    return kept
