"""Signature trees over token sets, and their dual traversal.

A leaf is a set: its size, its bitmap and a label.  An inner node covers ``FAN`` neighbours of the level
below: the OR of their bitmaps, their range of sizes, their label if they share one, and the largest
number of tokens that one of them loses by collisions on a bit.  A pair of nodes is dropped if it has one
label, if its sizes are too far apart, or if its largest possible overlap is below what a link needs:

    overlap <= popcount(A and B) + min(lost_A, lost_B),   a link needs 3 (n_A + n_B) / 7 at least.

Sets are ordered by label, labels by size, so that sets known to be alike share inner nodes.  Bitmaps have
four bits a token or more, a power of two; sets whose sizes may link have the same width or one twice as
wide, which is folded.  Nodes of a level are arrays, and a traversal step tests many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 4
STEP = 16_384  # pairs tested at once


def width_of(n: int) -> int:
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    """The set's bitmap, by the lowest bits of its tokens."""
    width = width_of(len(s))
    flags = np.zeros(width, bool)
    flags[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def links(a: int, b: int, common: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


class Tree:
    """Levels of one tree, leaves first.  rows: (node, n, bits as uint64 words, label, side)."""

    def __init__(self, node: np.ndarray, n: np.ndarray, bits: np.ndarray, label: np.ndarray, side: np.ndarray):
        self.node = node
        lost = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, lost, label, label, side, side)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            b, low, high, lost, label, label2, side, side2 = self.levels[-1]
            up, down = np.maximum.reduceat, np.minimum.reduceat
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), down(low, at), up(high, at), up(lost, at), down(label, at), up(label2, at), down(side, at), up(side2, at)))

    def count(self, level: int) -> int:
        return len(self.levels[level][0])


def _keep(x: Tree, y: Tree, lx: int, ly: int, i: np.ndarray, j: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs of nodes may hold a link."""
    xb, x_low, x_high, x_lost, x_label, x_label2, x_side, x_side2 = x.levels[lx]
    yb, y_low, y_high, y_lost, y_label, y_label2, y_side, y_side2 = y.levels[ly]
    ok = (x_label[i] != x_label2[i]) | (y_label[j] != y_label2[j]) | (x_label[i] != y_label[j])
    if cross:
        ok &= np.minimum(x_side[i], y_side[j]) != np.maximum(x_side2[i], y_side2[j])
    need = -(-3 * (x_low[i] + y_low[j]) // 7)
    need = np.maximum(need, -(-3 * np.maximum(x_low[i], y_low[j]) // 4))
    ok &= np.minimum(x_high[i], y_high[j]) >= need
    at = np.flatnonzero(ok)
    most = np.bitwise_count(xb[i[at]] & yb[j[at]]).sum(axis=1, dtype=np.int64) + np.minimum(x_lost[i[at]], y_lost[j[at]])
    ok[at[most < need[at]]] = False
    return ok


def _kids(i: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in i, child) of every child."""
    child = (i[:, None] * FAN + np.arange(FAN)).ravel()
    at = np.repeat(np.arange(len(i)), FAN)
    real = child < count
    return at[real], child[real]


def _traverse(x: Tree, y: Tree, same: bool, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may link."""
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        if len(i) > STEP:
            stack += [(lx, ly, i[k : k + STEP], j[k : k + STEP]) for k in range(0, len(i), STEP)]
            continue
        keep = _keep(x, y, lx, ly, i, j, cross)
        if same:  # a node may hold links of its own members
            keep |= (i == j) & (lx == ly) & (lx > 0)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if lx == ly == 0:
            yield i, j
            continue
        if lx > 0 and lx >= ly:
            at, i = _kids(i, x.count(lx - 1))
            j, lx = j[at], lx - 1
            if ly > lx + 1 or (ly == lx + 1 and lx > 0):  # keep in step but for the leaves, which meet inner nodes first
                at, j = _kids(j, y.count(ly - 1))
                i, ly = i[at], ly - 1
        else:
            at, j = _kids(j, y.count(ly - 1))
            i, ly = i[at], ly - 1
        if same:
            once = i < j if lx == ly == 0 else i <= j if lx == ly else i // FAN <= j
            i, j = i[once], j[once]
        stack.append((lx, ly, i, j))


def candidate_pairs(node: np.ndarray, n: np.ndarray, bits: list[bytes], label: np.ndarray, side: np.ndarray, cross: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of nodes of different labels (``cross``: and different sides) that may link."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    trees: dict[int, np.ndarray] = {}
    size = np.zeros(len(n), np.int64)  # of the smallest set of its label: orders labels by size
    _, at = np.unique(label, return_inverse=True)
    least = np.full(at.max() + 1 if len(at) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, at, n)
    size[:] = least[at]
    order = np.lexsort((node, n, label, size))
    for w in np.unique(width):
        trees[int(w)] = order[width[order] == w]

    def tree(rows: np.ndarray, w: int, fold: bool = False) -> Tree:
        words = np.frombuffer(b"".join(bits[k] for k in rows), np.uint64).reshape(len(rows), -1)
        if fold:
            words = words[:, : words.shape[1] // 2] | words[:, words.shape[1] // 2 :]
        return Tree(node[rows], n[rows], words, label[rows], side[rows])

    for w, rows in trees.items():
        own = tree(rows, w)
        found = [(own.node[i], own.node[j]) for i, j in _traverse(own, own, True, cross)] if len(rows) > 1 else []
        if 2 * w in trees:
            wide = tree(trees[2 * w], 2 * w, True)
            found += [(own.node[i], wide.node[j]) for i, j in _traverse(own, wide, False, cross)]
        for a, b in found:
            yield np.minimum(a, b), np.maximum(a, b)
