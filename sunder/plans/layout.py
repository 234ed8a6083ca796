"""Low-dimensional layouts of neighbour graphs, and Ward clusters of points; dense kernels behind a ceiling."""

from __future__ import annotations

import numpy as np

from sunder.errors import ConfigurationError
from sunder.plans.farthest import Points, nearest_columns

BLOCK = 1024
METRICS = ("euclidean", "cosine", "jaccard")


def nearest_rows(x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the ``k`` nearest other rows of each row, ties to the smaller position."""
    if metric == "jaccard":
        x = (x != 0).astype(float)
    elif metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
    elif metric != "euclidean":
        raise ConfigurationError(f"unknown metric {metric!r}")
    points, at, far = Points(x), [], []
    for i in points.blocks():
        if metric == "euclidean":
            d = points.between(i)
        else:
            dot = points.x[i] @ points.x.T
            if metric == "jaccard":
                union = points.square[i][:, None] + points.square[None] - dot
                d = 1 - np.divide(dot, union, out=np.ones(dot.shape), where=union > 0)
            else:
                d = np.maximum(1 - dot, 0)
        d[np.arange(len(i)), i] = np.inf
        near, value = nearest_columns(d, k)
        value = np.maximum(value.astype(float), 0)
        at.append(near)
        far.append(np.sqrt(value) if metric == "euclidean" else value)
    return np.concatenate(at), np.concatenate(far)


def fuzzy_graph(near: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(i, j, weight)`` with ``i < j`` of the fuzzy union of local neighbourhoods (McInnes et al. 2018, section 3.1)."""
    n, k = near.shape
    rho = np.where(d > 0, d, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0)
    gap = np.maximum(d - rho[:, None], 0)
    lo, hi = np.zeros(n), np.full(n, max(1.0, float(d.max(initial=0.0))) * 1e3)
    for _ in range(64):
        sigma = (lo + hi) / 2
        over = np.exp(-gap / np.maximum(sigma, 1e-12)[:, None]).sum(1) > np.log2(k)
        lo, hi = np.where(over, lo, sigma), np.where(over, sigma, hi)
    sigma = np.maximum((lo + hi) / 2, 1e-3 * max(float(d.mean()), 1e-12))
    p = np.exp(-gap / sigma[:, None]).ravel()
    i, j = np.repeat(np.arange(n), k), near.ravel()
    pair = np.minimum(i, j) * n + np.maximum(i, j)
    key, where = np.unique(pair, return_inverse=True)
    miss = np.ones(len(key))
    np.multiply.at(miss, where, 1 - p)  # p + q - p q
    return key // n, key % n, 1 - miss


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` of 1 / (1 + a d^2b), least squares against 1 up to ``min_dist`` and exponential decay beyond (Levenberg-Marquardt)."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    theta, damp = np.zeros(2), 1e-2  # logarithms of a and b
    model = lambda t: 1 / (1 + np.exp(t[0]) * d ** (2 * np.exp(t[1])))
    for _ in range(200):
        f = model(theta)
        slope = -f * (1 - f)
        jac = np.stack([slope, slope * 2 * np.exp(theta[1]) * np.log(d)], axis=1)
        hess = jac.T @ jac
        after = theta + np.linalg.solve(hess + damp * np.diag(np.diag(hess)), jac.T @ (want - f))
        better = ((model(after) - want) ** 2).sum() < ((f - want) ** 2).sum()
        theta, damp = (after, damp / 3) if better else (theta, damp * 4)
    return float(np.exp(theta[0])), float(np.exp(theta[1]))


def umap_layout(x: np.ndarray, rng: np.random.Generator, n_components=2, n_neighbors=15, min_dist=0.1, metric="euclidean", n_epochs=None, negatives=5) -> np.ndarray:
    """Uniform manifold approximation and projection (McInnes et al. 2018).

    Starts from principal scores; an edge is drawn in an epoch with a probability
    proportional to its weight, and moves apart from ``negatives`` random records.
    """
    n = len(x)
    near, d = nearest_rows(x, min(n_neighbors, n - 1), metric)
    i, j, w = fuzzy_graph(near, d)
    a, b = curve(min_dist)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = np.zeros((n, n_components))
    y[:, : min(n_components, len(s))] = (u * s)[:, :n_components]
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, y.shape)
    epochs = n_epochs or (500 if n <= 10_000 else 200)
    summed = lambda at, x: np.stack([np.bincount(at, c, n) for c in x.T], axis=1)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        drawn = rng.random(len(w)) < w / w.max()
        p, q = i[drawn], j[drawn]
        gap = y[p] - y[q]
        r = np.maximum((gap * gap).sum(1), 1e-12)
        power = r**b
        step = np.clip((-2 * a * b * power / (r * (1 + a * power)))[:, None] * gap, -4, 4)
        ends = np.concatenate((p, q))
        move = summed(ends, np.concatenate((step, -step)))
        own = y[ends]
        for _ in range(negatives):
            other = rng.integers(0, n, len(ends))
            gap = own - y[other]
            r = (gap * gap).sum(1)
            push = b / ((1e-3 + r) * (1 + a * r**b))
            # Both ends of an edge are heads here, each with half of the repulsion.
            push[ends == other] = 0
            move += summed(ends, np.clip(push[:, None] * gap, -2, 2))
        # All moves of an epoch are taken at once: a record's step is held to the longest single one.
        y = y + rate * np.clip(move, -4, 4)
    return y


def laplacian_vectors(near: np.ndarray, k: int, tolerance: float = 1e-8) -> np.ndarray:
    """Eigenvectors 2 to k + 1 of the normalised Laplacian of the symmetric graph of ``near`` (n x neighbours), by ascending eigenvalue.

    Block Krylov spaces of the normalised adjacency, restarted from the best vectors until the residuals are
    within ``tolerance``; small graphs are solved in full.
    """
    n = len(near)
    i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel().astype(np.int64)
    pair = np.unique(np.concatenate((i * n + j, j * n + i)))
    i, j = pair // n, pair % n
    root = 1 / np.sqrt(np.maximum(np.bincount(i, minlength=n), 1e-12))
    if n <= 2000:
        a = np.zeros((n, n))
        a[i, j] = root[i] * root[j]
        return np.linalg.eigh(np.eye(n) - a)[1][:, 1 : k + 1]
    start = np.searchsorted(i, np.arange(n))
    weight = root[i] * root[j]

    def times(v: np.ndarray) -> np.ndarray:
        # Half of I + A: eigenvalues in [0, 1], the wanted ones on top.
        return np.stack([(c + np.add.reduceat(weight * c[j], start)) / 2 for c in v.T], axis=1)

    wide, steps = k + 9, 8
    v = np.linalg.qr(np.random.default_rng(0).normal(size=(n, wide)))[0]
    v[:, 0] = 1 / root
    for _ in range(60):
        space = [np.linalg.qr(v)[0]]
        for _ in range(steps):
            w = times(space[-1])
            for _ in range(2):
                for b in space:
                    w -= b @ (b.T @ w)
            space.append(np.linalg.qr(w)[0])
        q = np.concatenate(space, axis=1)
        aq = times(q)
        value, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        turn = turn[:, ::-1][:, :wide]
        v = q @ turn
        off = np.linalg.norm(aq @ turn - v * value[::-1][:wide], axis=0)
        if off[: k + 1].max() <= tolerance:
            break
    return v[:, 1 : k + 1]


class _WardMates:
    """Each cluster's nearest one by Ward's cost, ties to the smaller position: clusters lie in cells, and only cells whose bound reaches the best are looked at."""

    def __init__(self, centre: np.ndarray, cell: int = 256):
        self.centre, self.mass, self.live, self.cell = centre, np.ones(len(centre)), np.ones(len(centre), bool), cell
        self.build()

    def build(self) -> None:
        """Cells of near clusters, by halves along the axis of largest spread."""
        at, todo, cells = np.flatnonzero(self.live), [], []
        todo.append(at)
        while todo:
            own = todo.pop()
            if len(own) <= self.cell:
                cells.append(np.sort(own))
                continue
            x = self.centre[own]
            axis, half = int(np.ptp(x, axis=0).argmax()), len(own) // 2
            order = np.argpartition(x[:, axis], half)
            todo += [own[order[:half]], own[order[half:]]]
        self.cells, self.of = cells, np.empty(len(self.live), int)
        for k, own in enumerate(cells):
            self.of[own] = k
        self.low = np.stack([self.centre[c].min(axis=0) for c in cells])
        self.high = np.stack([self.centre[c].max(axis=0) for c in cells])
        self.least = np.array([self.mass[c].min() for c in cells])
        self.left, self.built = len(at), len(at)

    def cost(self, i: int, j: np.ndarray) -> np.ndarray:
        return self.mass[j] * self.mass[i] / (self.mass[j] + self.mass[i]) * ((self.centre[j] - self.centre[i]) ** 2).sum(-1)

    def nearest(self, i: int) -> tuple[int, float]:
        x, m = self.centre[i], self.mass[i]
        out = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        bound = self.least * m / (self.least + m) * (out * out).sum(1) * (1 - 1e-9)
        best, least, done = -1, np.inf, np.zeros(len(bound), bool)
        first = int(self.of[i])
        while True:
            todo = np.array([first]) if first >= 0 else np.flatnonzero((bound <= least) & ~done)
            if not len(todo):
                return best, least
            if first < 0 and len(todo) > 4:
                todo = todo[np.argpartition(bound[todo], 3)[:4]]
            first, done[todo] = -1, True
            j = np.concatenate([self.cells[k] for k in todo])
            j = j[self.live[j] & (j != i)]
            if len(j):
                c = self.cost(i, j)
                low = c.min()
                at = int(j[c == low].min())
                if low < least or (low == least and at < best):
                    best, least = at, float(low)

    def merge(self, keep: int, gone: int) -> None:
        m, c = self.mass, self.centre
        c[keep] = (m[keep] * c[keep] + m[gone] * c[gone]) / (m[keep] + m[gone])
        m[keep] += m[gone]
        self.live[gone] = False
        k = self.of[keep]
        self.low[k], self.high[k] = np.minimum(self.low[k], c[keep]), np.maximum(self.high[k], c[keep])
        self.left -= 1
        if 5 * self.left < 4 * self.built:
            self.build()


def ward_labels(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` clusters by Ward's criterion, with nearest-neighbour chains over centroids; labels in order of first appearance."""
    n = len(points)
    mates, merges, chain, start = _WardMates(points.astype(float).copy()), [], [], 0
    while len(merges) < n - 1:
        if not chain:
            while not mates.live[start]:
                start += 1
            chain = [start]
        top = chain[-1]
        best, least = mates.nearest(top)
        back = float(mates.cost(top, np.array([chain[-2]]))[0]) if len(chain) > 1 else np.inf
        if back <= least and len(chain) > 1:
            keep, gone = sorted((top, chain[-2]))
            merges.append((back, keep, gone))
            mates.merge(keep, gone)
            del chain[-2:]
        else:
            chain.append(best)
    # A merge never comes before those it is made of: heights ascend along the tree.
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, keep, gone in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        a, b = find(keep), find(gone)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]
