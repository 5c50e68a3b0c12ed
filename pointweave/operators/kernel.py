"""Density clustering of one cloud that fits in a task, on numpy arrays.

Sites (distinct positions) are sorted by cell with x running fastest, so the cells that a site has to look at are a few
contiguous stretches of the sorted sites.  Every cell has eight parts of half its side, whose diagonal is under eps: a part
that holds ``min_pts`` points is *dense*, all its sites are core and belong together, and none of its pairs is looked at.
Two dense parts are joined by a pair of their sites, mostly by the two that are tried first; distances to everything around
are taken for the sites of the other parts only.  Candidate pairs are expanded a bounded number at a time; links are kept
while they are few and found again otherwise.

A larger cloud is cut into tiles, each with the two cells around it (``tile``).  Two cells are enough to know every core point
of the tile and of the cells next to it, so what is left to join are the tiles' parts of clusters, by sites along their sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from pointweave.functions.exprs import HALF, cell_scale, squared_radius

#: Candidate pairs that are looked at together, and links that are kept for the second pass.
CANDIDATES, LINKS = 1_000_000, 8_000_000
#: Cells from the origin up to which a float32 coordinate tells the halves of a cell well enough.
EXACT = 1 << 17
#: Cells along an axis, with one more at both ends: rows of cells never touch.
_SIDE = np.uint64(2 * HALF + 2)
_NONE = np.iinfo(np.int64).max


def _morton(v: np.ndarray) -> np.ndarray:
    """Codes of non-negative cell coordinates, x in the lowest bits."""
    out = np.zeros(len(v), np.int64)
    for bit in range(21):
        for axis in range(3):
            out |= (v[:, axis] >> bit & 1) << (3 * bit + axis)
    return out


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least member of each one's set) after the sets of every a and b have been joined."""
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, again := root[root]):
            root = again
    return root


def _expand(index: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each index with all places of its stretches (columns of ``start`` and ``end``), some CANDIDATES at a time."""
    length = end - start
    done = np.cumsum(length.sum(1))
    at = 0
    while at < len(index):
        until = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CANDIDATES, "right")))
        size = length[at:until].ravel()
        first = np.repeat(index[at:until], length[at:until].sum(1))
        second = np.arange(len(first)) + np.repeat(start[at:until].ravel() - (np.cumsum(size) - size), size)
        yield first, second
        at = until


class Sites:
    """Distinct positions of a cloud of finite points, in the order of their cells and parts of cells."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, eps: float, weight: np.ndarray | None = None):
        p = points.astype(np.float32) + np.float32(0)  # one zero
        scaled = np.clip(p * cell_scale(eps), np.float32(-HALF), np.float32(HALF - 1))
        low = np.floor(scaled)
        cell = low.astype(np.int64) + HALF
        part = ((scaled - low >= 0.5) @ np.array([1, 2, 4])).astype(np.int64)
        x, y, z = (cell[:, k].astype(np.uint64) + np.uint64(1) for k in range(3))
        key = (z * _SIDE + y) * _SIDE + x
        order = np.lexsort((p[:, 2], p[:, 1], p[:, 0], part, key))
        p, key, part = p[order], key[order], part[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]).any(1)
        first = np.flatnonzero(new)
        self.of_point = np.empty(len(p), np.int64)
        self.of_point[order] = np.cumsum(new) - 1
        self.weight = np.diff(np.append(first, len(p))) if weight is None else np.add.reduceat(weight[order], first)
        self.id = np.minimum.reduceat(ids[order], first)
        self.xyz = [np.ascontiguousarray(p[first, k]) for k in range(3)]
        self.key = key[first]
        self.code = _morton(cell[order][first])
        self.reach = np.float32(squared_radius(eps))
        # parts: where they begin, their weight, and whether their size is sure
        new_part = np.ones(len(first), bool)
        new_part[1:] = (self.key[1:] != self.key[:-1]) | (part[first][1:] != part[first][:-1])
        self.begin = np.flatnonzero(new_part)
        self.end = np.append(self.begin[1:], len(first))
        self.part = np.cumsum(new_part) - 1
        sure = (np.abs(scaled[order][first]) < EXACT).all(1)
        self.sure = np.minimum.reduceat(sure, self.begin)
        self.held = np.add.reduceat(self.weight, self.begin)

    def __len__(self) -> int:
        return len(self.key)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = [c[a] - c[b] for c in self.xyz]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= self.reach

    def around(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of the flagged sites: with any other site, each pair once."""
        index = np.flatnonzero(some)
        cells, inverse = np.unique(self.key[index], return_inverse=True)
        one, row, layer = np.uint64(1), _SIDE, _SIDE * _SIDE
        middles = [c + r for c in (cells - layer, cells, cells + layer) for r in (np.uint64(0) - row, np.uint64(0), row)]
        start = np.stack([np.searchsorted(self.key, m - one)[inverse] for m in middles], 1)
        end = np.stack([np.searchsorted(self.key, m + one, "right")[inverse] for m in middles], 1)
        for a, b in _expand(index, start, end):
            ok = self.near(a, b) & (~some[b] | (a < b))
            yield a[ok], b[ok]

    def join_dense(self, root: np.ndarray, dense: np.ndarray, eps: float) -> np.ndarray:
        """Joins the sites of each dense part, and dense parts with a link between them."""
        inside = dense[self.part]
        root = np.where(inside, self.begin[self.part], root)
        parts = np.flatnonzero(dense)
        begin, size = self.begin[parts], self.end[parts] - self.begin[parts]
        low = [np.minimum.reduceat(c, self.begin)[parts].astype(float) for c in self.xyz]
        high = [np.maximum.reduceat(c, self.begin)[parts].astype(float) for c in self.xyz]
        middle = begin + size // 2
        key = self.key[begin]
        one, row, layer = np.uint64(1), _SIDE, _SIDE * _SIDE
        start, end = [np.arange(1, len(parts) + 1)], [np.searchsorted(key, key + one, "right")]
        for step in (row, layer - row, layer, layer + row):
            start.append(np.searchsorted(key, key + step - one))
            end.append(np.searchsorted(key, key + step + one, "right"))
        left: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _expand(np.arange(len(parts)), np.stack(start, 1), np.stack(end, 1)):
            gap = sum(np.maximum(0, np.maximum(lo[a] - hi[b], lo[b] - hi[a])) ** 2 for lo, hi in zip(low, high, strict=True))
            a, b = a[close := gap <= float(self.reach) * 1.0001], b[close]
            hit = self.near(middle[a], middle[b])
            root = union(root, begin[a[hit]], begin[b[hit]])
            left.append((a[~hit], b[~hit]))
        a, b = (np.concatenate(c) for c in zip(*left, strict=True)) if left else (parts[:0], parts[:0])
        while len(a):  # pairs of parts that are still apart, nearly always few
            apart = root[begin[a]] != root[begin[b]]
            a, b = a[apart], b[apart]
            many = max(1, int(np.searchsorted(np.cumsum(size[a] * size[b]), CANDIDATES, "right")))
            some_a, some_b, a, b = a[:many], b[:many], a[many:], b[many:]
            for k in range(0, int(size[some_a].max(initial=0)), slice_of := max(1, CANDIDATES // max(1, int(size[some_b].max(initial=1))))):
                rows = np.clip(size[some_a] - k, 0, slice_of)
                total = rows * size[some_b]
                place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                width = np.repeat(size[some_b], total)
                p = np.repeat(begin[some_a] + k, total) + place // width
                q = np.repeat(begin[some_b], total) + place % width
                hit = self.near(p, q)
                root = union(root, p[hit], q[hit])
        return root


def _linked(sites: Sites, some: np.ndarray) -> tuple[np.ndarray, Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]]:
    """Points around every flagged site, its own included, and the links of flagged sites to go over again."""
    count, kept, size = sites.weight.astype(np.float64), [], 0
    for a, b in sites.around(some):
        count += np.bincount(a, sites.weight[b], len(sites)) + np.bincount(b, sites.weight[a], len(sites))
        size += len(a)
        if size <= LINKS:
            kept.append((a.astype(np.int32), b.astype(np.int32)))
        else:
            kept = []
    return count, (lambda: kept) if size <= LINKS else (lambda: sites.around(some))


def cluster(points: np.ndarray, ids: np.ndarray, eps: float, min_pts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(is_core, label)`` of every point; ``points`` has rows of three float32, of which non-finite ones are noise."""
    is_core, label = np.zeros(len(points), bool), np.zeros(len(points), np.int64)
    fine = np.flatnonzero(np.isfinite(points).all(1))
    if not len(fine):
        return is_core, label
    with np.errstate(over="ignore"):  # an infinite distance is no link
        sites = Sites(points[fine], ids[fine], eps)
        dense = sites.sure & (sites.held >= min_pts)
        core = dense[sites.part]
        count, pairs = _linked(sites, ~core)
        core |= count >= min_pts
        root = sites.join_dense(np.arange(len(sites)), dense, eps)
        for a, b in pairs():
            both = core[a] & core[b]
            root = union(root, a[both], b[both])
        number = np.zeros(len(sites), np.int64)
        ordered = np.lexsort((sites.id, sites.code))
        ordered = ordered[core[ordered]]
        roots, first = np.unique(root[ordered], return_index=True)
        number[roots[np.argsort(first)]] = np.arange(1, len(roots) + 1)
        of_site = np.where(core, number[root], _NONE)
        for a, b in pairs():
            for p, q in ((a, b), (b, a)):
                edge = core[p] & ~core[q]
                np.minimum.at(of_site, q[edge], number[root[p[edge]]])
        of_site[of_site == _NONE] = 0
    is_core[fine], label[fine] = core[sites.of_point], of_site[sites.of_point]
    return is_core, label


def tile(points: np.ndarray, ids: np.ndarray, weight: np.ndarray, least: np.ndarray, place: np.ndarray, side: int, eps: float, min_pts: int) -> dict[str, tuple[np.ndarray, ...]]:
    """What the rows of one tile and its surroundings (distinct finite positions) tell about the tile's own sites.

    ``place`` has the cells from the tile's lowest corner: 0 to ``side`` - 1 inside, two more on each side.  A *node* stands
    for a part of a cluster: the smallest of its own core sites, or a core site of the surroundings that touches none of those.

    * noise: x, y, z of sites without a core site in reach
    * held: x, y, z, is_core, node of the others; a border site has a row for each node in its reach
    * links: pairs of nodes and sites along the sides of tiles that belong to one cluster
    * first: node, Morton code and ``least`` of its first own core site
    """
    with np.errstate(over="ignore"):
        sites = Sites(points, ids, eps, weight)
        of = sites.of_point
        out = np.maximum(-place, place - (side - 1)).max(1)
        ring, side_cell, first_id = np.zeros(len(sites), np.int64), np.zeros(len(sites), bool), np.zeros(len(sites), np.int64)
        ring[of], side_cell[of], first_id[of] = np.maximum(out, 0), out == 0, least
        own, inner = ring == 0, ring < 2
        dense = sites.sure & (sites.held >= min_pts)
        core = dense[sites.part]
        count, pairs = _linked(sites, ~core & inner)
        core = (core | (count >= min_pts)) & inner
        root = sites.join_dense(np.arange(len(sites)), dense, eps)
        for a, b in pairs():
            both = core[a] & core[b]
            root = union(root, a[both], b[both])
        mine = np.flatnonzero(own & core)
        smallest = np.full(len(sites), _NONE)
        np.minimum.at(smallest, root[mine], sites.id[mine])
        node = np.where(smallest[root] == _NONE, sites.id, smallest[root])
        reach = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in pairs():
            for p, q in ((a, b), (b, a)):
                edge = core[p] & own[q] & ~core[q]
                reach.append((q[edge].astype(np.int64), node[p[edge]]))
    border = np.unique(np.stack([np.concatenate(c) for c in zip(*reach, strict=True)], 1), axis=0)
    held = np.concatenate([mine, border[:, 0]])
    noise = own & ~core
    noise[border[:, 0]] = False
    link = np.flatnonzero(core & (sites.id != node) & (smallest[root] != _NONE) & np.where(own, side_cell, ring == 1))
    ordered = mine[np.lexsort((first_id[mine], sites.code[mine]))]
    nodes, at = np.unique(node[ordered], return_index=True)
    return {
        "noise": tuple(c[noise] for c in sites.xyz),
        "held": (*(c[held] for c in sites.xyz), core[held], np.concatenate([node[mine], border[:, 1]])),
        "links": (sites.id[link], node[link]),
        "first": (nodes, sites.code[ordered[at]], first_id[ordered[at]]),
    }
