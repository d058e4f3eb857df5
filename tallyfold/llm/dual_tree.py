"""Cover trees in numpy, and nearest centroids by walking a tree of vectors and a tree of centroids together.

A cover tree's nodes are points. A node of level l has children of lower levels within 2^(l+1) of it, and the points of
one level and above are more than 2^l apart. It is built from the order in which the point farthest from all points
so far is taken next. Vectors have integer components; bounds are taken in floating point with a margin, and what
they leave is compared exactly, in integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a node that has no children of its own, on average.
LEAF = 8
#: Relative margin of all bounds, far above the rounding of distances.
MARGIN = 1e-9
#: Components of vectors that one step compares.
STEP = 4_000_000


@dataclass
class Tree:
    """order: the points, those below a node side by side. By node: point (its place in that order), radius of all below
    it, lo to hi the points below it; its children are kids[first:last]. Nodes without children are leaves."""

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kids: np.ndarray

    FIELDS = ("order", "point", "radius", "lo", "hi", "first", "last", "kids")

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in self.FIELDS]


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, nearest centre of every point, parent of every centre), for most centres at most.

    A centre's parent is the nearest of those centres whose level is higher.
    """
    n = len(x)
    norms = np.einsum("ij,ij->i", x, x)
    centres, parent = [0], [-1]
    near, dist = np.zeros(n, np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    levels = [np.inf]
    while len(centres) < most:
        far = int(np.argmax(dist))
        r = float(dist[far])
        if r <= 0:
            break
        level = int(np.ceil(np.log2(r))) - 1  # 2^level < r <= 2^(level + 1)
        above = np.flatnonzero(np.array(levels) > level)
        to = ((x[np.array(centres)[above]] - x[far]) ** 2).sum(axis=1)
        parent.append(int(above[np.argmin(to)]))
        levels.append(level)
        centres.append(far)
        d = np.sqrt(np.maximum(norms - 2 * (x @ x[far]) + norms[far], 0))
        d[far] = 0
        closer = d < dist
        near[closer], dist[closer] = len(centres) - 1, d[closer]
    return np.array(centres), near, np.array(parent)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of the rows of x. Each centre is a node, and has a leaf of the points that are nearest to it beside its children."""
    x = x.astype(float)
    centres, near, parent = farthest_first(x, max(1, -(-len(x) // leaf)))
    m = len(centres)
    kids: list[list[int]] = [[m + j] for j in range(m)]
    for j in range(1, m):
        kids[parent[j]].append(j)
    by_centre = np.argsort(near, kind="stable")
    starts = np.searchsorted(near[by_centre], np.arange(m + 1))
    order, lo, hi = [], np.zeros(2 * m, np.int64), np.zeros(2 * m, np.int64)
    stack, at = [(0, False)], 0
    while stack:
        j, seen = stack.pop()
        if seen:
            hi[j] = at
        elif j < m:
            lo[j] = at
            stack.append((j, True))
            stack += [(k, False) for k in reversed(kids[j])]
        else:
            order.append(by_centre[starts[j - m] : starts[j - m + 1]])
            lo[j], at = at, at + len(order[-1])
            hi[j] = at
    order = np.concatenate(order)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    y = x[order]
    radius = [np.sqrt(((y[lo[j] : hi[j]] - x[centres[j % m]]) ** 2).sum(axis=1).max()) for j in range(2 * m)]
    sizes = np.array([len(k) for k in kids] + [0] * m, np.int64)
    last = np.cumsum(sizes)
    return Tree(order, np.tile(place[centres], 2), np.array(radius), lo, hi, last - sizes, last, np.array([k for ks in kids for k in ks], np.int64))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: (which range, number in it) of all their numbers, one after the other."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def leaf_pairs(x: np.ndarray, t: Tree, c: np.ndarray, ct: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, centroid): for each leaf of t, the centroids (by their place in ct's order) that may be nearest to its points.

    x and c are in the trees' orders. A pair of nodes is dropped where its least distance is beyond what another centroid
    is sure to offer to all points of the vectors' node. Ties are never dropped. The centroids' node is opened where it
    is the wider one, else the vectors'.
    """
    x, c = x.astype(float), c.astype(float)
    a, b, single = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)  # single: b is one centroid, not a node
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        while True:
            at = np.where(single, b, ct.point[b % len(ct.point)])
            d = np.sqrt(((x[t.point[a]] - c[at]) ** 2).sum(axis=1))
            spread = np.where(single, 0.0, ct.radius[b % len(ct.point)])
            new = np.concatenate([[True], a[1:] != a[:-1]])
            sure = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1] + t.radius[a]
            keep = d - t.radius[a] - spread <= sure + MARGIN * (1 + d + sure + spread)
            a, b, single, spread = a[keep], b[keep], single[keep], spread[keep]
            split = ~single & ((spread >= t.radius[a]) | (t.first[a] == t.last[a]))
            if not split.any():
                break
            node = b[split]
            leaf = ct.first[node] == ct.last[node]
            own, points = _spread(ct.lo[node], np.where(leaf, ct.hi[node], ct.lo[node]))
            below, place = _spread(ct.first[node], ct.last[node])
            base = a[split]
            a = np.concatenate([a[~split], base[own], base[below]])
            b = np.concatenate([b[~split], points, ct.kids[place]])
            single = np.concatenate([single[~split], np.ones(len(own), bool), np.zeros(len(below), bool)])
            sort = np.argsort(a, kind="stable")
            a, b, single = a[sort], b[sort], single[sort]
        leaf = t.first[a] == t.last[a]
        found.append((a[leaf], b[leaf]))
        pair, place = _spread(t.first[a], t.last[a])
        a, b, single = t.kids[place], b[pair], single[pair]
        sort = np.argsort(a, kind="stable")
        a, b, single = a[sort], b[sort], single[sort]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def nearest(x: np.ndarray, t: Tree, centroids: np.ndarray, ct: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) for the rows of x, in t's order; ties go to the smaller number.

    centroids are in the order of their numbers.
    """
    node, place = leaf_pairs(x, t, centroids[ct.order], ct)
    number = ct.order[place]
    sort = np.lexsort((number, t.lo[node]))
    node, number = node[sort], number[sort]
    best, far = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    # 32 bits where no squared distance can need more.
    widest = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = np.int32 if widest * widest * x.shape[1] < 1 << 31 else np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    size = t.hi[node] - t.lo[node]
    step = max(1, STEP // x.shape[1])
    ends = np.flatnonzero(np.concatenate([node[1:] != node[:-1], [True]])) + 1  # a node's pairs stay together
    begin = 0
    while begin < len(node):
        wanted = np.searchsorted(np.cumsum(size[begin:]), step) + begin
        stop = int(ends[min(np.searchsorted(ends, max(wanted, begin + 1)), len(ends) - 1)])
        pair, p = _spread(t.lo[node[begin:stop]], t.hi[node[begin:stop]])
        k = number[begin:stop][pair]
        diff = x[p] - centroids[k]
        d = np.einsum("ij,ij->i", diff, diff)
        by = np.lexsort((k, d, p))
        p, k, d = p[by], k[by], d[by]
        one = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        best[p[one]], far[p[one]] = k[one], d[one]
        begin = stop
    return best, far
