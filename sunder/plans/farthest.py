"""Farthest-first picks and farthest pairs over points, in memory that grows with the points and not with their pairs.

Picks are those of the matrix of all distances, ties to the smaller position.  Distances of
integers below 2^22 in square are exact in single precision, and are computed in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ROWS = 128  # rows of distances at once


class Points:
    """Squared distances by blocks; ``metric(d, i, j)`` makes another distance of those between positions i and j.

    With ``classes`` the metric rises with d and is otherwise the same for all positions j of a class.
    """

    def __init__(self, x: np.ndarray, metric: Callable | None = None):
        square = (x * x).sum(1)
        exact = len(x) > 0 and square.max() < 2**22 and (x == np.floor(x)).all()
        kind = np.float32 if exact else np.float64
        self.x, self.square, self.metric, self.classes = x.astype(kind), square.astype(kind), metric, None
        # Exact sums come out of one product, whatever their order.
        one = np.ones((len(x), 1), kind)
        self.sides = (np.hstack((-2 * self.x, self.square[:, None], one)), np.hstack((self.x, one, self.square[:, None]))) if exact else None

    def __len__(self) -> int:
        return len(self.x)

    def squares(self, i: np.ndarray, j: np.ndarray | slice = slice(None)) -> np.ndarray:
        if self.sides is not None:
            return self.sides[0][i] @ self.sides[1][j].T
        d = self.x[i] @ self.x[j].T
        d *= -2
        d += self.square[i][:, None]
        d += self.square[j][None, :]
        return d

    def between(self, i: np.ndarray, j: np.ndarray | slice = slice(None)) -> np.ndarray:
        d = self.squares(i, j)
        return d if self.metric is None else self.metric(d, i, j)

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Each row's distance to the nearest of the positions j."""
        if self.classes is None:
            return self.between(i, j).min(axis=1)
        j = j[np.argsort(self.classes[j], kind="stable")]
        first = np.flatnonzero(np.diff(self.classes[j], prepend=-1))
        if 8 * len(first) > len(j):
            return self.between(i, j).min(axis=1)
        return self.metric(np.minimum.reduceat(self.squares(i, j), first, axis=1), i, j[first]).min(axis=1)

    def one(self, i: int) -> np.ndarray:
        return self.between(np.array([i]))[0]

    def blocks(self):
        for i in range(0, len(self), ROWS):
            yield np.arange(i, min(i + ROWS, len(self)))

    def farthest_pair(self) -> tuple[int, int]:
        """The first (i, j) of the largest distance, by i and then by j."""
        best, pair = -np.inf, (0, 0)
        for i in self.blocks():
            d = self.between(i, slice(int(i[0]), None))
            at = int(d.argmax())
            if d.flat[at] > best:
                best, (r, c) = d.flat[at], divmod(at, d.shape[1])
                pair = (int(i[r]), int(i[0]) + c)
        return pair

    def farthest_pair_within(self, most: np.ndarray, back: Callable) -> tuple[int, int]:
        """``farthest_pair`` by the metric, where it is at most ``most[i]`` more than one of squared distance ``back`` of the rest: others are not worked out."""
        metric, self.metric = self.metric, None
        a, b = (np.array([x]) for x in self.farthest_pair())
        self.metric = metric
        best, pair, sure = -np.inf, (0, 0), float(self.between(a, b)[0, 0]) * (1 - 1e-9)
        for i in self.blocks():
            d = self.squares(i, slice(int(i[0]), None))
            flat = np.flatnonzero(d >= back(max(best, sure) - most[i])[:, None])
            if len(flat):
                r, c = np.divmod(flat, d.shape[1])
                far = self.metric(d.ravel()[flat][:, None], i[r], (int(i[0]) + c)[:, None])[:, 0]
                at = int(far.argmax())
                if far[at] > best:
                    best, pair = far[at], (int(i[r[at]]), int(i[0]) + int(c[at]))
        return pair

    def totals(self) -> np.ndarray:
        """The sum of squared distances to all points, in closed form."""
        x, square = self.x.astype(float), self.square.astype(float)
        return len(x) * square + square.sum() - 2 * (x @ x.sum(0))


class FarthestFirst:
    """The free point farthest from those picked so far, again and again.

    Distances to the picks only fall, so that old ones are upper bounds: a few points with the largest
    bounds are kept up to date, and one of them comes next as long as no bound outside reaches it.
    """

    def __init__(self, points: Points, start: list[int], free: np.ndarray, hot: int = 512):
        self.points, self.free, self.hot = points, free, hot
        self.picks = np.empty(len(points) + len(start), int)
        self.count = len(start)
        self.picks[: self.count] = start
        self.near = points.between(np.array(start)).min(axis=0)
        self.seen = np.full(len(points), self.count)
        self.own = np.empty(0, int)
        self.bound, self.first = np.inf, -1

    def add(self, i: int) -> None:
        self.picks[self.count] = i
        self.count += 1
        if len(self.own):
            self.near[self.own] = np.minimum(self.near[self.own], self.points.between(np.array([i]), self.own)[0])
            self.seen[self.own] = self.count

    def _gather(self) -> None:
        """The free points with the largest bounds, the smaller positions of equal ones, up to date."""
        at = np.flatnonzero(self.free)
        near = self.near[at]
        if len(at) > self.hot:
            cut = -np.partition(-near, self.hot - 1)[self.hot - 1]
            above, equal = at[near > cut], at[near == cut]
            inside = self.hot - len(above)
            self.own = np.sort(np.concatenate((above, equal[:inside])))
            rest = np.setdiff1d(at, self.own, assume_unique=True)
            self.bound = self.near[rest].max()
            self.first = int(rest[self.near[rest] == self.bound][0])
        else:
            self.own, self.bound, self.first = at, -np.inf, -1
        old = self.own[np.argsort(self.seen[self.own], kind="stable")]
        for k in range(0, len(old), 64):
            part = old[k : k + 64]
            for since in range(int(self.seen[part[0]]), self.count, 65_536):
                late = self.picks[since : min(since + 65_536, self.count)]
                self.near[part] = np.minimum(self.near[part], self.points.least(part, late))
            self.seen[part] = self.count

    def next(self) -> int:
        while True:
            own = self.own[self.free[self.own]]
            if len(own) != len(self.own):
                self.own = own
            if len(own):
                k = int(self.near[own].argmax())
                i, far = int(own[k]), self.near[own[k]]
                if far > self.bound or (far == self.bound and i < self.first) or not np.isfinite(self.bound):
                    return i
            self._gather()


class FarthestPairs:
    """The farthest pair of free points, again and again; ``own`` is a point's distance to itself."""

    def __init__(self, points: Points, own: float):
        self.points, self.own, self.free = points, own, np.ones(len(points), bool)
        self.far, self.mate = np.empty(len(points)), np.empty(len(points), int)
        for i in points.blocks():
            self._look(i)

    def _look(self, i: np.ndarray) -> None:
        d = self.points.between(i)
        d[:, ~self.free] = -2
        d[np.arange(len(i)), i] = self.own
        self.mate[i] = d.argmax(axis=1)
        self.far[i] = d[np.arange(len(i)), self.mate[i]]

    def next(self) -> tuple[int, int]:
        while True:
            far = np.where(self.free, self.far, -3.0)
            i = int(far.argmax())
            if self.free[self.mate[i]]:
                return i, int(self.mate[i])
            # Old distances are upper bounds: those next in turn look for another mate.
            stale = np.flatnonzero(self.free & ~self.free[self.mate])
            if len(stale) > 64:
                stale = stale[np.argpartition(-far[stale], 63)[:64]]
            self._look(np.union1d(stale, [i]))


def nearest_columns(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` smallest entries of each row, ascending, ties to the smaller column.

    The k-th smallest of the minima of groups of columns bounds the k-th smallest entry: few entries reach it.
    """
    n = d.shape[1]
    wide = max(1, min(64, n // (4 * k)))
    m = n // wide
    bound = np.partition(d[:, : wide * m].reshape(len(d), wide, m).min(axis=1), k - 1, axis=1)[:, k - 1]
    flat = np.flatnonzero(d <= bound[:, None])
    value, row = d.ravel()[flat], flat // n
    order = np.lexsort((value, row))
    first = order[np.searchsorted(row, np.arange(len(d)))[:, None] + np.arange(k)]
    return flat[first] % n, value[first]


def nearest_positions(points: Points, k: int) -> np.ndarray:
    """Positions of each point's nearest ones, at places 1 to ``k`` of a stable order by distance: the first place is left out, as the point's own."""
    last = min(k, len(points) - 1)
    return np.concatenate([nearest_columns(points.between(i), last + 1)[0][:, 1:] for i in points.blocks()])
