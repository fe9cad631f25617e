"""A tree of pivots over vectors: fitted on a sample, descended to place vectors, pruned by true bounds to search."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Children of a node.
FAN = 16
#: Distances that are taken at once, exactly or by a matrix product: temporaries that stay in a core's cache.
EXACT_AT_ONCE, PRODUCTS_AT_ONCE = 1 << 15, 1 << 18


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, in slices of `a` that keep temporaries small.

    The squares are summed one dimension after the other: every machine adds in
    the same order, and d(a, b) equals d(b, a) to the last bit. Equal distances
    are then ordered by id.
    """
    step = max(1, EXACT_AT_ONCE // max(1, len(b)))
    out = np.empty((len(a), len(b)))
    across = np.ascontiguousarray(b.T)
    for i in range(0, len(a), step):
        total = np.zeros((len(a[i : i + step]), len(b)))
        for d in range(a.shape[1]):
            gap = a[i : i + step, d, None] - across[d]
            gap *= gap
            total += gap
        out[i : i + step] = np.sqrt(total)
    return out


def _pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of `a` from that row of `b`, with the bits that `distances` gives."""
    out = np.empty(len(a))
    step = max(1, PRODUCTS_AT_ONCE // max(1, a.shape[1]))
    for i in range(0, len(a), step):
        gap = a[i : i + step] - b[i : i + step]
        squares = np.ascontiguousarray((gap * gap).T)
        total = np.zeros(len(gap))
        for square in squares:
            total += square
        out[i : i + step] = np.sqrt(total)
    return out


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a long and nearly empty mask is set, ascending; eight places are looked at together."""
    whole = len(mask) // 8 * 8
    eights = np.flatnonzero(mask[:whole].view(np.uint64))
    places = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[mask[places]], whole + np.flatnonzero(mask[whole:])])


def _first(keep: int, row: np.ndarray, column: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance, place) of the `keep` nearest of each row; ties go to the smaller column."""
    order = np.lexsort((column, distance, row))
    row, column, distance = row[order], column[order], distance[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    kept = place < keep
    return row[kept], column[kept], distance[kept], place[kept]


def closest(
    a: np.ndarray, b: np.ndarray, limit: np.ndarray, keep: int, meetings: Iterable[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance): the `keep` nearest, within its limit, that each row of `a` meets, nearest first.

    `meetings` are pairs of rows of `a` and rows of `b`, both ascending; no two
    rows may meet twice. A matrix product in single precision about the middle of
    the rows met tells squares up to `slack`, several times what it can be wrong
    by; only what that leaves possible has its distance taken, in the order of
    `distances`. What was found lowers a row's limit for what comes. Ties go to
    the smaller column.
    """
    limit = limit.copy()
    groups = max(64, 4 * keep)
    doubt = 4 * (a.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def possible(rows: np.ndarray, columns: np.ndarray, middle: np.ndarray, y: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            x = a[rows] - middle
            xx = np.einsum("ij,ij->i", x, x)
            slack = doubt * (np.sqrt(xx) + np.sqrt(yy.max())) ** 2 + 1e-30
            most = limit[rows] * limit[rows] + slack
        if not (slack < 1e30).all():
            exact = distances(a[rows], b[columns])
            row, column = np.nonzero(~(exact > limit[rows, None]))
            return row, column, exact[row, column]
        square = (-2 * x).astype(np.float32) @ y.T
        square += xx.astype(np.float32)[:, None]
        square += yy.astype(np.float32)
        mask = square <= np.minimum(most, 3e38).astype(np.float32)[:, None]
        depth = len(columns) // groups
        if depth > 1 and np.count_nonzero(mask) > 2 * keep * len(rows):
            # A row's `keep` least minima of groups are as many vectors within the last of them.
            least = square[:, : groups * depth].reshape(len(rows), depth, groups).min(axis=1)
            within = np.partition(least, keep - 1, axis=1)[:, keep - 1] + slack
            mask = square <= np.minimum(within, most).astype(np.float32)[:, None]
        row, column = np.divmod(_places(mask.ravel()), len(columns))
        return row, column, _pair_distances(a[rows[row]], b[columns[column]])

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column, distance, place = _first(keep, *(np.concatenate(v) for v in zip(held, *waiting, strict=True)))
        last = place == keep - 1
        limit[row[last]] = np.fmin(limit[row[last]], distance[last])
        return row, column, distance

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    waiting, n = [], 0
    for mine, theirs in meetings:
        if not len(mine) or not len(theirs):
            continue
        middle = b[theirs].mean(axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            y = b[theirs] - middle
            yy = np.einsum("ij,ij->i", y, y)
            y = y.astype(np.float32)
        step = max(1, PRODUCTS_AT_ONCE // len(theirs))
        for i in range(0, len(mine), step):
            rows = mine[i : i + step]
            row, column, distance = possible(rows, theirs, middle, y, yy)
            within = ~(distance > limit[rows[row]])
            row, column, distance = row[within], column[within], distance[within]
            if len(row) > 2 * keep * len(rows):
                row, column, distance, _ = _first(keep, row, column, distance)
            waiting.append((rows[row], theirs[column], distance))
            n += len(row)
        if n > 2 * keep * len(a):
            held, waiting, n = merged(), [], 0
    return merged()


class PivotTree:
    """Nodes in breadth-first order, each with a pivot; node 0 is the root and has none.

    A vector belongs to the child whose pivot is nearest, down to a leaf. The
    pivots come from a sample; counts and radii are those of all vectors
    (`measure`), so that bounds hold whatever the sample was.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        pivots, first, children, members = [np.zeros(sample.shape[1])], [0], [0], [np.arange(len(sample))]
        open_, made = [0], 1
        # The fullest leaf is divided next, so that leaves come out about equal.
        while made < leaves and open_:
            node = max(open_, key=lambda n: len(members[n]))
            open_.remove(node)
            own = sample[members[node]]
            centres = self._divide(own, min(FAN, leaves - made + 1), draw)
            if len(centres) < 2:
                continue
            nearest = distances(own, centres).argmin(axis=1)
            first[node], children[node] = len(pivots), len(centres)
            for c, centre in enumerate(centres):
                open_.append(len(pivots))
                pivots.append(centre)
                first.append(0)
                children.append(0)
                members.append(members[node][nearest == c])
            made += len(centres) - 1
        self.pivots, self.first, self.children = np.array(pivots), np.array(first), np.array(children)
        self.counts = np.zeros(len(pivots), np.int64)
        self.radii = np.zeros(len(pivots))

    @staticmethod
    def _divide(rows: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
        """At most n centres of groups of the rows, by two rounds of means from rows drawn at random."""
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return distinct
        centres = distinct[draw.choice(len(distinct), min(n, len(distinct)), replace=False)]
        for _ in range(2):
            nearest = distances(rows, centres).argmin(axis=1)
            kept = np.unique(nearest)
            centres = np.array([rows[nearest == c].mean(axis=0) for c in kept])
        return np.unique(centres, axis=0)

    def place(self, rows: np.ndarray) -> tuple[list[list[int]], list[list[float]]]:
        """For each row the nodes from below the root to its leaf, and the distances to their pivots."""
        paths: list[list[int]] = [[] for _ in rows]
        far: list[list[float]] = [[] for _ in rows]
        waiting = {0: np.arange(len(rows))}
        while waiting:
            node, own = waiting.popitem()
            if not self.children[node]:
                continue
            begin, n = self.first[node], self.children[node]
            d = distances(rows[own], self.pivots[begin : begin + n])
            child = d.argmin(axis=1)
            for i, c, x in zip(own.tolist(), child.tolist(), d[np.arange(len(own)), child].tolist(), strict=True):
                paths[i].append(int(begin + c))
                far[i].append(x)
            for c in np.unique(child):
                waiting[int(begin + c)] = own[child == c]
        return paths, far

    def measure(self, nodes: dict[int, tuple[int, float]], total: int) -> None:
        """Set the counts and radii of all vectors: {node: (count, radius)}."""
        self.counts[0], self.radii[0] = total, np.inf
        for node, (count, radius) in nodes.items():
            self.counts[node], self.radii[node] = count, radius

    def reach(self, path: list[int], far: list[float], k: int) -> float:
        """A radius around a placed vector that surely holds k vectors: the deepest node with as many lies within it."""
        for node, d in zip(reversed(path), reversed(far), strict=True):
            if self.counts[node] >= k:
                return d + float(self.radii[node])
        return np.inf

    def visits(self, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves that may hold a vector within `radius` of a row.

        All vectors of a node lie within its radius of its pivot, and nearer to
        that than to any other child's: beyond the plane between the two.
        """
        limit = radius * (1 + 1e-9) + 1e-9
        found_rows, found_leaves = [], []
        waiting = {0: np.arange(len(rows))}
        while waiting:
            node, own = waiting.popitem()
            if not self.children[node]:
                if self.counts[node]:
                    found_rows.append(own)
                    found_leaves.append(np.full(len(own), node))
                continue
            begin, n = self.first[node], self.children[node]
            pivots = self.pivots[begin : begin + n]
            d = distances(rows[own], pivots)
            nearest = d.argmin(axis=1)
            close = d[np.arange(len(own)), nearest]
            apart = distances(pivots, pivots)[nearest]
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = np.where(apart > 0, (d**2 - close[:, None] ** 2) / (2 * apart), 0.0)
            least = np.maximum(d - self.radii[begin : begin + n], beyond)
            wanted = (least <= limit[own][:, None]) & (self.counts[begin : begin + n] > 0)
            for c in np.flatnonzero(wanted.any(axis=0)):
                waiting[int(begin + c)] = own[wanted[:, c]]
        if not found_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_rows), np.concatenate(found_leaves)
