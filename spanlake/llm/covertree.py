"""A cover tree over norm-augmented vectors, searched by inner product within windows."""

from __future__ import annotations

import numpy as np


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b; by floats where these are exact, else by longs (which wrap)."""
    most = float(max(np.abs(a).max(initial=0), 1)) * float(max(np.abs(b).max(initial=0), 1)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more coordinate, which gives all of them the norm `most`."""
    y = x.astype(np.float64)
    return np.hstack((y, np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", y, y), 0))[:, None]))


def bounds(products: np.ndarray, squares: np.ndarray, most: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries with anything within `radius` of augmented centres.

    `products` are those of queries (rows) and centres, `squares` the queries' squared norms. As all
    augmented vectors have the norm `most`, a distance tells the inner product and the other way round.
    """
    both = squares[:, None] + most * most
    far = np.sqrt(np.maximum(both - 2 * products, 0))
    slack = 1e-9 * (both + 1)
    return (both - (far + radius) ** 2) / 2 - slack, (both - np.maximum(far - radius, 0) ** 2) / 2 + slack


class CoverTree:
    """Nodes hold points within a radius of their centre, which is one of them; children's centres are
    further than the next smaller radius from each other and the first child has its parent's centre.

    Radii shrink by `base` from level to level. A node of at most `leaf` points isn't divided, nor one of up
    to 4,096 whose children would hold fewer than 16 points each, and where `most_children` centres leave over half of a node uncovered, the rest joins the nearest of
    them, with radii to match: vectors without structure have no smaller cover.
    """

    def __init__(self, x: np.ndarray, most: float, base: float = 1.2, leaf: int = 256, most_children: int = 512):
        self.most = most
        y = augmented(x, most)
        self.order = np.arange(len(x))
        self.centre, self.radius, self.parent, self.begin, self.end, self.leaf = [], [], [], [], [], []

        def node(centre: int, radius: float, parent: int, begin: int, end: int) -> int:
            for held, value in zip((self.centre, self.radius, self.parent, self.begin, self.end, self.leaf), (centre, radius, parent, begin, end, end - begin <= leaf or radius == 0), strict=True):
                held.append(value)
            return len(self.centre) - 1

        self.levels: list[list[int]] = []
        level = [node(0, float(np.linalg.norm(y - y[0], axis=1).max()), -1, 0, len(x))]
        while level:
            self.levels.append(level)
            below: list[int] = []
            for v in level:
                if not self.leaf[v]:
                    below += self._divide(v, y, base, most_children, node)
            level = below
        self.centre, self.parent, self.begin, self.end = (np.array(c, np.int64) for c in (self.centre, self.parent, self.begin, self.end))
        self.radius, self.leaf = np.array(self.radius), np.array(self.leaf)

    def _divide(self, v: int, y: np.ndarray, base: float, most_children: int, node) -> list[int]:
        begin, end, radius = self.begin[v], self.end[v], self.radius[v] / base
        rows = self.order[begin:end]
        left = np.concatenate(([self.centre[v]], rows[rows != self.centre[v]]))
        centres, members, reach = [], [], []
        while len(left):
            if len(centres) == most_children and 2 * len(left) > len(rows):
                far = np.sqrt(np.maximum(2 * self.most**2 - 2 * (y[left] @ y[centres].T), 0))
                nearest = far.argmin(axis=1)
                own = np.linalg.norm(y[left] - y[np.array(centres)[nearest]], axis=1)
                for i in np.unique(nearest):
                    members[i] = np.concatenate((members[i], left[nearest == i]))
                    reach[i] = max(reach[i], own[nearest == i].max())
                break
            far = np.linalg.norm(y[left] - y[left[0]], axis=1)
            near = far <= radius
            near[0] = True
            centres.append(left[0])
            members.append(left[near])
            reach.append(far[near].max())
            left = left[~near]
        if len(rows) < 16 * len(centres) and len(rows) <= 4096:
            self.leaf[v] = True
            return []
        out = []
        for c, m, r in zip(centres, members, reach, strict=True):
            self.order[begin : begin + len(m)] = m
            out.append(node(int(c), float(r), v, begin, begin + len(m)))
            begin += len(m)
        return out


def _ranked(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, window, score, row, id) the first k of each query and window by score and id."""
    ask, window, score, row, ids = found
    order = np.lexsort((row, ids, -score, window, ask))
    ask, window = ask[order], window[order]
    new = np.concatenate(([True], (ask[1:] != ask[:-1]) | (window[1:] != window[:-1])))
    no = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = order[no < k]
    return [c[keep] for c in found]


def search(tree: CoverTree, x, labels, ids, queries, query_labels, low, high, least, same: bool, k: int, step: int = 256) -> list[np.ndarray]:
    """Of each query and window the first k rows of the same label (or of another) by inner product, ties to the smaller id.

    low, high, least: for each query and window the smallest and greatest score asked for (integers; an
    empty window has low > high), and a score that k rows are known to reach. Level by level,
    nodes go whose bounds lie outside all windows or below what k rows reach; leaves are then opened
    best first, and after each round those that can't add anything go as well. Rows of the leaves
    are scored exactly. Gives arrays: query, window, score, row.
    """
    x = x[tree.order]
    labels, ids = labels[tree.order], ids[tree.order]
    centres = x[np.argsort(tree.order)[tree.centre]].astype(np.float64)
    leaves = np.flatnonzero(tree.leaf)
    done: list[list[np.ndarray]] = []
    for lo in range(0, len(queries), step):
        q, own, floor, top, reached = (c[lo : lo + step] for c in (queries, query_labels, low, high, least))
        reached = np.maximum(reached, floor)
        y = q.astype(np.float64)
        least_at, most_at = bounds(y @ centres.T, np.einsum("ij,ij->i", y, y), tree.most, tree.radius)

        def open_nodes(nodes, reached, top=top, floor=floor, least_at=least_at, most_at=most_at):
            out = np.zeros((len(top), len(nodes)), bool)
            for j in range(top.shape[1]):
                out |= (most_at[:, nodes] >= reached[:, j : j + 1]) & (least_at[:, nodes] <= top[:, j : j + 1]) & (floor[:, j] <= top[:, j])[:, None]
            return out

        alive = np.zeros(least_at.shape, bool)
        for i, level in enumerate(tree.levels):
            level = np.array(level)
            alive[:, level] = open_nodes(level, reached) & (alive[:, tree.parent[level]] if i else True)
        left = alive[:, leaves]
        rank = np.argsort(np.argsort(np.where(left, -most_at[:, leaves], np.inf), axis=1, kind="stable"), axis=1)
        found, wide, first = [np.zeros(0, np.int64)] * 5, 1, 0
        while left.any():
            now, new = left & (rank < first + wide), [found]
            lowest, highest = np.where(floor <= top, reached, np.iinfo(np.int64).max).min(axis=1), top.max(axis=1)
            for i in np.flatnonzero(now.any(axis=0)):
                ask = np.flatnonzero(now[:, i])
                rows = np.arange(tree.begin[leaves[i]], tree.end[leaves[i]])
                score = exact_products(q[ask], x[rows])
                # few rows lie in any window, above what k rows reach; only these are looked at window by window
                a, r = np.nonzero((score >= lowest[ask][:, None]) & (score <= highest[ask][:, None]))
                fit = (labels[rows[r]] == own[ask[a]]) == same
                a, r = ask[a[fit]], r[fit]
                value = score[np.searchsorted(ask, a), r]
                e, j = np.nonzero((value[:, None] >= reached[a]) & (value[:, None] <= top[a]))
                new.append([a[e], j, value[e], rows[r[e]], ids[rows[r[e]]]])
            left &= ~now
            first, wide = first + wide, wide * 2
            found = _ranked([np.concatenate(p) for p in zip(*new, strict=True)], k)
            full = np.zeros(reached.shape, np.int64)
            np.add.at(full, (found[0], found[1]), 1)
            kth = np.full(reached.shape, np.iinfo(np.int64).max)
            np.minimum.at(kth, (found[0], found[1]), found[2])
            reached = np.where(full == k, np.maximum(reached, kth), reached)
            left &= open_nodes(leaves, reached)
        done.append([found[0] + lo, found[1], found[2], tree.order[found[3]]])
    return [np.concatenate(c) for c in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 4
