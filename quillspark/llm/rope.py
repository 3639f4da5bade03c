"""A rope: a balanced tree over a text, for splits and joins that copy no text.

A leaf holds up to LEAF units of text; leaves and inner nodes cache how many
units and how many code points lie below them. A unit is a code point, or what
a pattern matches: then a unit goes from the beginning of its match to the
beginning of the next one, and text before the first match belongs to the
first unit. Nodes never change, so trees share subtrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Units of a leaf.
LEAF = 1024


class Rope:
    """A leaf (`text`, and where its units start; None: at every code point)
    or an inner node (`left` and `right`)."""

    __slots__ = ("chars", "height", "left", "right", "starts", "text", "units")

    def __init__(self, text: str | None, starts: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        if text is None:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)
        else:
            self.units, self.chars, self.height = len(text) if starts is None else len(starts), len(text), 0

    def leaves(self) -> Iterator[str]:
        open_nodes = [self]
        while open_nodes:
            node = open_nodes.pop()
            if node.text is not None:
                yield node.text
            else:
                open_nodes += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope("")


def rope(text: str, unit: str | None = None) -> Rope:
    """The balanced tree of a text."""
    if unit is None:
        parts = [Rope(text[i : i + LEAF]) for i in range(0, len(text), LEAF)]
    else:
        starts = [m.start() for m in re.finditer(unit, text)]
        if not starts:
            return Rope(text, [])
        starts[0] = 0
        ends = [*starts[LEAF::LEAF], len(text)]
        parts = [Rope(text[own[0] : end], [s - own[0] for s in own]) for end, own in zip(ends, (starts[i : i + LEAF] for i in range(0, len(starts), LEAF)), strict=True)]
    while len(parts) > 1:
        pairs = [Rope(None, None, a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        if len(parts) % 2:
            pairs[-1] = joined(pairs[-1], parts[-1])
        parts = pairs
    return parts[0] if parts else EMPTY


def _node(a: Rope, b: Rope) -> Rope:
    """The node of two trees whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope(None, None, a.left, Rope(None, None, a.right, b))
        return Rope(None, None, Rope(None, None, a.left, a.right.left), Rope(None, None, a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope(None, None, Rope(None, None, a, b.left), b.right)
        return Rope(None, None, Rope(None, None, a, b.left.left), Rope(None, None, b.left.right, b.right))
    return Rope(None, None, a, b)


def joined(*ropes: Rope) -> Rope:
    """The ropes one after the other, balanced; goes down one edge only."""
    out = EMPTY
    for r in ropes:
        out = _joined(out, r)
    return out


def _joined(a: Rope, b: Rope) -> Rope:
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _node(a.left, _joined(a.right, b))
    if b.height > a.height + 1:
        return _node(_joined(a, b.left), b.right)
    return Rope(None, None, a, b)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The tree before and after its first `rank` units (or "chars")."""
    if tree.text is not None:
        if rank >= getattr(tree, by):  # also where there is no unit: text goes to the left
            return (tree, EMPTY) if rank or not tree.chars or by == "chars" else (EMPTY, tree)
        if tree.starts is None:
            return Rope(tree.text[:rank]), Rope(tree.text[rank:])
        at = tree.starts[rank] if by == "units" else rank
        return Rope(tree.text[:at], [s for s in tree.starts if s < at]), Rope(tree.text[at:], [s - at for s in tree.starts if s >= at])
    here = getattr(tree.left, by)
    if rank < here:
        a, b = split(tree.left, rank, by)
        return a, _joined(b, tree.right)
    if rank == here:
        return tree.left, tree.right
    a, b = split(tree.right, rank - here, by)
    return _joined(tree.left, a), b
