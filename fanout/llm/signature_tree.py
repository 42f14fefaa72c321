"""Signature trees over token sets, and their dual traversal inside one task.

A node holds the OR of its members' token bitmaps, their size range, the most tokens that any member has
beyond one per bit, the most tokens that any member has from the group's key on, and the members' component
if it is a single one. A pair of nodes is dropped when no pair of members can reach the similarity: sizes
too far apart, too few common bits or too few tokens from the key on for the overlap that the smallest
members would need, or both sides in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32
FANOUT = 8
NARROW, WIDE = 64, 1 << 18
# Bits a token, before rounding up to a power of two. At one bit a token two unlike sets of a size seem to share up to
# 0.77 of it, well below the 0.89 that a Jaccard of 0.8 needs; at half a bit it would be 0.94, and all would seem alike.
COARSE, FINE = 1.0, 8.0


def width_for(n: int, bits: float) -> int:
    """Bits of the bitmap of a set: so many a token, rounded up to a power of two, within bounds."""
    return min(WIDE, max(NARROW, 1 << max(0, int(bits * n) - 1).bit_length()))


def bitmap(values: np.ndarray, bits: float) -> np.ndarray:
    width = width_for(len(values), bits)
    flags = np.zeros(width, np.uint8)
    flags[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at a smaller power-of-two width: position modulo the new width."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Node:
    __slots__ = ("lo", "hi", "rest", "bits", "extra", "component", "members", "children")

    def __init__(self, lo, hi, rest, bits, extra, component, members=None, children=()):
        self.lo, self.hi, self.rest, self.bits, self.extra = lo, hi, rest, bits, extra
        self.component, self.members, self.children = component, members, children


class Sets:
    """What a task knows of the sets of one group: ids, sizes, bitmaps, components.

    ``rest`` is how many tokens each set has from the group's key on, in the order that the key is taken from: two
    sets whose first common token is the key have no more in common.
    """

    def __init__(self, ids, sizes, bitmaps, component, rest=None):
        self.ids = ids
        self.sizes = np.asarray(sizes, np.int64)
        self.rest = self.sizes if rest is None else np.asarray(rest, np.int64)
        self.bitmaps = bitmaps
        self.component = np.asarray(component, np.int64)
        self.extra = self.sizes - np.array([int(np.bitwise_count(b).sum()) for b in bitmaps], np.int64)

    def tree(self, members: np.ndarray) -> Node:
        order = members[np.lexsort((self.sizes[members], self.component[members]))]
        level = [self._leaf(order[i : i + LEAF]) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [_parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        return level[0]

    def _leaf(self, members: np.ndarray) -> Node:
        words = min(len(self.bitmaps[m]) for m in members)
        folded = [fold(self.bitmaps[m], words) for m in members]
        extra = max(int(self.sizes[m] - np.bitwise_count(b).sum()) for m, b in zip(members, folded, strict=True))
        sizes, owners = self.sizes[members], self.component[members]
        component = owners[0] if (owners == owners[0]).all() else None
        bits = np.bitwise_or.reduce(np.stack(folded), axis=0)
        return Node(sizes.min(), sizes.max(), self.rest[members].max(), bits, extra, component, members)


def _parent(children: list[Node]) -> Node:
    words = min(len(c.bits) for c in children)
    bits = np.bitwise_or.reduce(np.stack([fold(c.bits, words) for c in children]), axis=0)
    owners = {c.component for c in children}
    # folding merges bits, and each merged bit may carry one token more
    extra = max(c.extra + int(np.bitwise_count(c.bits).sum() - np.bitwise_count(fold(c.bits, words)).sum()) for c in children)
    return Node(
        min(c.lo for c in children),
        max(c.hi for c in children),
        max(c.rest for c in children),
        bits,
        extra,
        owners.pop() if len(owners) == 1 else None,
        children=children,
    )


def _possible(u: Node, v: Node, num: int, den: int) -> bool:
    if u.component is not None and u.component == v.component:
        return False
    if u.hi * den < num * v.lo or v.hi * den < num * u.lo:
        return False
    if min(u.rest, v.rest) * (num + den) < num * (u.lo + v.lo):
        return False
    words = min(len(u.bits), len(v.bits))
    a, b = fold(u.bits, words), fold(v.bits, words)
    common = int(np.bitwise_count(a & b).sum())
    most = min(
        common + u.extra + int(np.bitwise_count(u.bits).sum() - np.bitwise_count(a).sum()),
        common + v.extra + int(np.bitwise_count(v.bits).sum() - np.bitwise_count(b).sum()),
        u.hi,
        v.hi,
    )
    return most * (num + den) >= num * (u.lo + v.lo)


def _member_pairs(s: Sets, u: Node, v: Node, num: int, den: int) -> Iterator[tuple[int, int]]:
    a, b = u.members, v.members
    na, nb = s.sizes[a][:, None], s.sizes[b][None, :]
    fits = (na * den >= num * nb) & (nb * den >= num * na) & (s.component[a][:, None] != s.component[b][None, :])
    fits &= np.minimum(s.rest[a][:, None], s.rest[b][None, :]) * (num + den) >= num * (na + nb)
    if u is v:
        fits &= np.triu(np.ones(fits.shape, bool), 1)
    left, right = np.nonzero(fits)
    if not len(left):
        return
    words = min(min(len(s.bitmaps[m]) for m in a), min(len(s.bitmaps[m]) for m in b))
    x = np.stack([fold(s.bitmaps[m], words) for m in a])
    y = x if u is v else np.stack([fold(s.bitmaps[m], words) for m in b])
    step = max(1, (1 << 20) // words)
    for at in range(0, len(left), step):
        i, j = left[at : at + step], right[at : at + step]
        p, q = x[i], y[j]
        most = np.minimum(
            s.sizes[a[i]] - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64),
            s.sizes[b[j]] - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64),
        )
        keep = most * (num + den) >= num * (s.sizes[a[i]] + s.sizes[b[j]])
        yield from zip(a[i[keep]].tolist(), b[j[keep]].tolist(), strict=True)


def candidates(s: Sets, left: Node, right: Node, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Member pairs that may reach num/den, by traversing both trees (or one with itself) together."""
    stack = [(left, right)]
    while stack:
        u, v = stack.pop()
        if not _possible(u, v, num, den):
            continue
        if u.members is not None and v.members is not None:
            yield from _member_pairs(s, u, v, num, den)
        elif u is v:
            c = u.children
            stack.extend((c[i], c[j]) for i in range(len(c)) for j in range(i, len(c)))
        elif v.members is not None or (u.members is None and len(u.children) >= len(v.children)):
            stack.extend((c, v) for c in u.children)
        else:
            stack.extend((u, c) for c in v.children)


def reaches(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether Jaccard of two sorted distinct arrays is num/den or more, exactly."""
    total = len(x) + len(y)
    if min(len(x), len(y)) * (num + den) < num * total:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * (num + den) >= num * total


class Joining:
    """Which members of a group are connected, as one array that the traversal reads while it runs."""

    def __init__(self, s: Sets):
        _, self.of = np.unique(s.component, return_inverse=True)
        self.members = [[] for _ in range(int(self.of.max(initial=-1)) + 1)]
        for i, label in enumerate(self.of.tolist()):
            self.members[label].append(i)
        s.component = self.of

    def apart(self, i: int, j: int) -> bool:
        return self.of[i] != self.of[j]

    def join(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
