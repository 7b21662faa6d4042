"""Exact links between sets of integers under the Jaccard distance, by recursive Voronoi regions, for what one task holds.

d(x, y) = 1 - |x & y| / |x | y| is a metric; two sets link at d <= r. Pivots are sets of the region. Each set belongs to
the region of its nearest pivot, if that is within 2 r, else to a rest without a pivot. A pair is found in the region of
its earlier pivot, the rest being the last: the other set is copied there as a window copy if it is within the region's
own radius plus r of the pivot, and no more than 2 r farther from it than from its own pivot (triangle inequality).
Regions are split again, however small, until they hold one set or one component, or split no more.
"""

from __future__ import annotations

import numpy as np

SLACK = 1e-9


def regions(d: np.ndarray, core: np.ndarray, r: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, whether own or a window copy) of each region. d: distances (pivots, sets); core: not window copies."""
    least, out = d.min(axis=0), []
    place = np.where(core & (least <= 2 * r + SLACK), d.argmin(axis=0), len(d))
    for p in range(len(d)):
        own = core & (place == p)
        if own.any():
            window = ~own & (~core | (place > p)) & (d[p] <= d[p][own].max() + r + SLACK) & (d[p] - least <= 2 * r + SLACK)
            at = np.flatnonzero(own | window)
            out.append((at, own[at]))
    rest = core & (place == len(d))
    if rest.any():
        # what is within r of a rest's set is farther than r from every pivot
        at = np.flatnonzero(rest | (~core & (least > r - SLACK)))
        out.append((at, rest[at]))
    return out


class Space:
    """Sets (elements one after another, and where each begins), and the components of the links found so far.

    Overlaps are counted over the sets that hold an element, so what is in one set alone costs nothing.
    """

    def __init__(self, elements: np.ndarray, first: np.ndarray, percent: int, label: np.ndarray | None = None):
        self.n, self.percent, self.r = np.diff(first), percent, 1 - percent / 100
        _, ids, often = np.unique(elements, return_inverse=True, return_counts=True)
        ids, rows = ids.reshape(-1), np.repeat(np.arange(len(self.n)), self.n)
        shared = often[ids] > 1
        ids, rows = ids[shared], rows[shared]
        self.rows = rows[np.argsort(ids, kind="stable")]  # the sets that hold an element, element by element
        self.end = np.cumsum(np.bincount(ids, minlength=len(often)))
        self.often = np.where(often > 1, often, 0)
        self.ids, self.first = ids, np.searchsorted(rows, np.arange(len(self.n) + 1))
        self.label = np.arange(len(self.n)) if label is None else label.copy()
        self.compared = 0

    def distances(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Distances of set x to some sets; its links are noted."""
        own = self.ids[self.first[x] : self.first[x + 1]]
        n = self.often[own]
        end = np.cumsum(n)
        held = self.rows[np.arange(n.sum()) + np.repeat(self.end[own] - end, n)]
        common = np.bincount(held, minlength=len(self.n))[rows]
        self.compared += len(rows)
        # a shingle that only x has is in its overlap with itself
        common = np.where(rows == x, self.n[x], common)
        union = self.n[x] + self.n[rows] - common
        old = np.unique(self.label[np.append(rows[100 * common >= self.percent * union], x)])
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]
        return 1 - common / union

    def pivots(self, rows: np.ndarray, core: np.ndarray, most: int) -> np.ndarray:
        """Distances of pivots to the rows: first the set of the commonest elements, then the farthest from all before."""
        total = np.concatenate([[0], np.cumsum(self.often[self.ids])])
        x = int(np.where(core, (total[self.first[rows + 1]] - total[self.first[rows]]) / self.n[rows], -1).argmax())
        d = [self.distances(int(rows[x]), rows)]
        while len(d) < most:
            least = np.where(core, np.min(d, axis=0), -1)
            x = int(least.argmax())
            if least[x] <= self.r:
                break
            d.append(self.distances(int(rows[x]), rows))
        return np.array(d)

    def compare(self, rows: np.ndarray, core: np.ndarray, d: np.ndarray) -> None:
        """Each own set with those of other components whose sizes and distances to the pivots allow a link."""
        n = self.n[rows]
        for i in np.flatnonzero(core).tolist():
            other = (~core | (np.arange(len(rows)) > i)) & (self.label[rows] != self.label[rows[i]])
            other &= 100 * np.minimum(n, n[i]) >= self.percent * np.maximum(n, n[i])
            other &= (np.abs(d - d[:, i : i + 1]) <= self.r + SLACK).all(axis=0)
            if other.any():
                self.distances(int(rows[i]), rows[other])

    def join(self, core: np.ndarray | None = None, most: int = 8, leaf: int = 1) -> np.ndarray:
        """The component of every set, counting all links of a set that is not a window copy."""
        todo = [(np.arange(len(self.n)), np.ones(len(self.n), bool) if core is None else core)] if len(self.n) else []
        while todo:
            rows, core = todo.pop()
            if not core.any() or (self.label[rows] == self.label[rows[0]]).all():
                continue
            if len(rows) <= leaf:
                self.compare(rows, core, np.zeros((1, len(rows))))
                continue
            d = self.pivots(rows, core, most)
            for at, own in regions(d, core, self.r):
                if len(at) > 0.8 * len(rows):
                    self.compare(rows[at], own, d[:, at])
                else:
                    todo.append((rows[at], own))
        return self.label
