"""Splits in a latent space: k-means, projections, self-organising maps, spectral clusters, designs, and shift-aware choices."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sunder.errors import ConfigurationError, ConvergenceWarning, InputError, MissingDependencyError, SunderError
from sunder.functions.sizes import floor_round, resolve_sizes
from sunder.operators.similarity import fill_remainder
from sunder.plans.distance import nearest
from sunder.plans.farthest import Points, nearest_positions
from sunder.plans.groups import assign_groups
from sunder.plans.kernels import single_task
from sunder.plans.layout import METRICS, laplacian_vectors, umap_layout, ward_labels
from sunder.plans.rank import running_shares, value_rank
from sunder.plans.scratch import Scratch

SPLIT = "id long, partition string"
LINEAR = 2_000_000  # records of a kernel that holds all vectors, but not their pairs


def cluster_count(n: int, rule: str = "sqrt_n", limits: tuple[int, int] = (2, 50)) -> int:
    """The square root of n, or n / 50, within limits and below n."""
    k = floor_round(math.sqrt(n)) if rule == "sqrt_n" else n // 50
    return max(limits[0], min(limits[1], k, n - 1))


def k_means_keys(vectors: DataFrame, n_clusters: int | None = None, seed: int = 0) -> DataFrame:
    """``id, key`` by k-means."""
    k = n_clusters or cluster_count(vectors.count())
    data = vectors.select("id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").cast("long").alias("key"))


def latent_space(vectors: DataFrame, normalize: str = "l2", n_clusters: int | None = None, seed: int = 0, **sizes) -> DataFrame:
    """``id, partition, group``: clusters of a user's embedding stay whole."""
    if normalize == "l2":
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        vectors = vectors.select("id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("v"))
    elif normalize != "none":
        raise ConfigurationError(f"unknown normalisation {normalize!r}")
    return assign_groups(k_means_keys(vectors, n_clusters, seed), "id", F.col("key"), check=False, **sizes)


def _gram(vectors: DataFrame) -> np.ndarray:
    """The sum of outer products, which partitions add up."""
    dim = vectors.select(F.size("v")).first()[0]

    def partial(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"i": range(dim), "row": list(total)})

    rows = vectors.select("v").mapInPandas(partial, "i int, row array<double>")
    summed = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in summed:  # a number of dimensions squared
        gram[r.i, r.j] = r.x
    return gram


def whitened(vectors: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``id, v``: vectors whose euclidean distances are the Mahalanobis distances of the given ones.

    The covariance is that of both tables' records; directions without variance count as nothing.
    """
    every = vectors.select("v") if reference is None else vectors.select("v").unionByName(reference.select("v"))
    # A leading 1 brings the sums and the count along.
    gram = _gram(every.select(F.concat(F.array(F.lit(1.0)), "v").alias("v")))
    n, sums = gram[0, 0], gram[0, 1:]
    if n < 2:
        raise InputError("a covariance takes two records")
    value, axes = np.linalg.eigh((gram[1:, 1:] - np.outer(sums, sums) / n) / (n - 1))
    live = value > 1e-12 * max(value.max(), 0.0)
    axes = axes[:, live] / np.sqrt(value[live])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "v": list(np.stack(pdf["v"].to_numpy()) @ axes)})

    return vectors.select("id", "v").mapInPandas(run, "id long, v array<double>")


def principal_axes(vectors: DataFrame, n_components: int = 2) -> np.ndarray:
    """Right singular vectors (uncentred)."""
    value, axes = np.linalg.eigh(_gram(vectors))
    axes = axes[:, np.argsort(-value)[:n_components]]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])


def project(vectors: DataFrame, n_components: int = 2) -> DataFrame:
    """``id, c0, c1, ...``: scores on the principal axes."""
    axes = principal_axes(vectors, n_components)
    dot = lambda k: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", *[dot(k).alias(f"c{k}") for k in range(n_components)])


def projection(vectors: DataFrame, mode: str = "axis_cut", axis: int = 0, grid_bins: int = 4, method: str = "pca", seed: int = 0, **sizes) -> DataFrame:
    """``id, partition``: a cut along an axis, or whole cells of a quantile grid, or whole clusters of the scores."""
    if method not in ("pca", "svd"):
        raise MissingDependencyError(f"{method}: no implementation is installed")
    scores = project(vectors)
    resolved = resolve_sizes(vectors.count(), **sizes)
    if mode == "axis_cut":
        ranked = value_rank(scores, F.col(f"c{axis}"), "id")
        part = F.when(F.col("pos") < resolved.train, "train").when(F.col("pos") < resolved.train + resolved.valid, "valid").otherwise("test")
        return ranked.select("id", part.alias("partition"))
    if mode == "grid":
        cuts = [k / grid_bins for k in range(1, grid_bins)]
        edges = scores.agg(*[F.percentile(c, F.array(*[F.lit(x) for x in cuts])).alias(c) for c in ("c0", "c1")]).first()
        bin_of = lambda c: sum((F.when(F.col(c) > float(e), 1).otherwise(0) for e in edges[c]), F.lit(0))
        keys = scores.select("id", (bin_of("c0") * grid_bins + bin_of("c1")).cast("long").alias("key"))
    elif mode == "cluster":
        keys = k_means_keys(scores.select("id", F.array("c0", "c1").alias("v")), seed=seed)
    else:
        raise ConfigurationError(f"unknown mode {mode!r}")
    return assign_groups(keys, "id", F.col("key"), check=False, **sizes).select("id", "partition")


def umap_keys(
    vectors: DataFrame, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", n_epochs: int | None = None, n_clusters: int | None = None, seed: int = 0
) -> DataFrame:
    """``id, key``: Ward clusters of a UMAP layout of the vectors; ``metric`` is euclidean, cosine or jaccard (of non-zero components)."""
    if n_components < 1 or n_neighbors < 2 or not 0 <= min_dist <= 1 or (n_clusters is not None and n_clusters < 1):
        raise ConfigurationError("umap: n_components and n_clusters are at least 1, n_neighbors at least 2, min_dist is in [0, 1]")
    if metric not in METRICS:
        raise ConfigurationError(f"unknown metric {metric!r}")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        y = umap_layout(x, np.random.default_rng(seed), n_components, n_neighbors, min_dist, metric, n_epochs)
        return pd.DataFrame({"id": pdf["id"], "key": ward_labels(y, n_clusters or cluster_count(len(x)))})

    return single_task(vectors, kernel, "id long, key long", LINEAR)


def som_keys(vectors: DataFrame, grid: int | None = None, epochs: int = 10, seed: int = 0) -> DataFrame:
    """``id, key``: cells of a Kohonen map (1982), trained record by record with a shrinking Gaussian neighbourhood."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        side = grid or min(50, math.ceil(math.sqrt(5 * math.sqrt(len(x)))))
        rng = np.random.default_rng(seed)
        w = x[rng.integers(0, len(x), side * side)] + rng.normal(0, 1e-3, (side * side, x.shape[1]))
        total, step, lines = epochs * len(x), 0, np.arange(side)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for own in (x[order[i : i + 32]] for i in range(0, len(x), 32)):
                # Cells are held as scale * (w + given @ own) until the block ends: its records meet cells as they are by then.
                meet, dot, norm = own @ own.T, w @ own.T, (w * w).sum(1)
                scale, given = np.ones(len(w)), np.zeros((len(w), len(own)), order="F")
                for t in range(len(own)):
                    left = 1 - step / total
                    now = scale * (dot[:, t] + given[:, :t] @ meet[:t, t])
                    r, c = divmod(int((norm - 2 * now).argmin()), side)
                    reach = max(0.5, side / 2 * left)
                    near = lambda at, reach=reach: np.exp(-((lines - at) ** 2) / (2 * reach * reach))
                    pull = (0.5 * left * near(r)[:, None] * near(c)[None, :]).ravel()
                    stay = 1 - pull
                    norm = stay * stay * norm + 2 * pull * stay * now + pull * pull * meet[t, t]
                    scale *= stay
                    given[:, t] = pull / scale
                    step += 1
                w = scale[:, None] * (w + given @ own)
        cell = np.concatenate([((w * w).sum(1) - 2 * (x[i : i + 4096] @ w.T)).argmin(1) for i in range(0, len(x), 4096)])
        return pd.DataFrame({"id": pdf["id"], "key": cell})

    return single_task(vectors, kernel, "id long, key long", LINEAR)


def spectral_keys(vectors: DataFrame, n_clusters: int = 8, knn: int = 20, seed: int = 0) -> DataFrame:
    """``id, key``: k-means on the leading eigenvectors of the normalised Laplacian of a k-nearest graph (Ng et al. 2002)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        u = laplacian_vectors(nearest_positions(Points(x), knn), n_clusters)
        u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = u[rng.choice(len(u), n_clusters, replace=False)]
        for _ in range(50):
            label = np.stack([((u - row) ** 2).sum(-1) for row in c], axis=1).argmin(1)
            after = np.stack([u[label == k].mean(0) if (label == k).any() else c[k] for k in range(n_clusters)])
            if np.allclose(after, c):
                break
            c = after
        return pd.DataFrame({"id": pdf["id"], "key": label})

    return single_task(vectors, kernel, "id long, key long", LINEAR)


def opti_sim(vectors: DataFrame, radius: float, n_picks: int, subsample: int | None = None, seed: int = 0) -> DataFrame:
    """``id, key``: OptiSim (Clark 1997): each pick is the best of a random subsample outside the radius; others join their nearest pick."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        k = subsample or math.ceil(len(x) / 20)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x)).tolist()
        picked = [order.pop(0)]
        near = ((x - x[picked[0]]) ** 2).sum(1)
        pool = order
        while pool and len(picked) < n_picks:
            draw, rest = [], []
            for i in pool:
                if len(draw) < k and near[i] > radius:
                    draw.append(i)
                elif near[i] > radius:
                    rest.append(i)
            if not draw:
                break
            best = max(draw, key=lambda i: (near[i], -i))
            picked.append(best)
            near = np.minimum(near, ((x - x[best]) ** 2).sum(1))
            pool = rest + [i for i in draw if i != best]
        centre, least = np.zeros(len(x), int), np.full(len(x), np.inf)
        for k, i in enumerate(picked):
            d = ((x - x[i]) ** 2).sum(1)
            centre[d < least], least = k, np.minimum(least, d)
        return pd.DataFrame({"id": pdf["id"], "key": pdf["id"].to_numpy()[np.array(picked)[centre]]})

    return single_task(vectors, kernel, "id long, key long", LINEAR)


def fedorov_exchange(z: np.ndarray, design: np.ndarray, ridge: float, passes: int) -> tuple[np.ndarray, bool, int]:
    """Swap each design row for the row outside that raises the determinant most, pass by pass until one makes no swap.

    Returns the design, whether such a pass was reached, and the number of swaps.
    """
    design, inside, swaps = np.sort(design), np.zeros(len(z), bool), 0
    inside[design] = True

    def informed():
        inv = np.linalg.inv(z[inside].T @ z[inside] + ridge * np.eye(z.shape[1]))
        g, come = np.einsum("ij,jk,ik->i", z, inv, z), np.flatnonzero(~inside)
        return inv, g, come, g[come].max(initial=-np.inf)

    inv, g, come, most = informed()
    if not len(come):
        return design, True, 0
    for _ in range(passes):
        before = swaps
        for at in range(len(design)):
            i = design[at]
            # By Cauchy and Schwarz no gain is above this difference.
            if most - g[i] <= 0.5e-10:
                continue
            gain = g[come] - g[i] - (g[i] * g[come] - (z[come] @ (inv @ z[i])) ** 2)
            best = int(gain.argmax())
            if gain[best] > 1e-10:
                design[at] = come[best]
                inside[i], inside[come[best]] = False, True
                inv, g, come, most = informed()
                swaps += 1
        if swaps == before:
            return np.sort(design), True, swaps
    return np.sort(design), False, swaps


def d_optimal(vectors: DataFrame, n_components: int = 5, ridge: float = 1e-8, passes: int = 100, **sizes) -> DataFrame:
    """``id, partition``: train maximises the determinant of its information matrix, by Fedorov exchange (1972) on principal scores.

    A pass visits every record of the design; a ``ConvergenceWarning`` tells of a limit that is hit before a pass makes no swap.
    """
    resolved = resolve_sizes(vectors.count(), **sizes)
    k = resolved.train

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        z = np.hstack([np.ones((len(x), 1)), (u * s)[:, :n_components]])
        design, settled, swaps = fedorov_exchange(z, np.argsort(-(z * z).sum(1), kind="stable")[:k], ridge, passes)
        part = np.full(len(x), None, dtype=object)
        part[design] = "train"
        return pd.DataFrame({"id": pdf["id"], "partition": part, "settled": settled, "swaps": swaps})

    found = Scratch(vectors.sparkSession, "d_optimal").keep(single_task(vectors, kernel, f"{SPLIT}, settled boolean, swaps long", LINEAR))
    open_ = found.where(~F.col("settled")).select("swaps").first()
    if open_ is not None:
        warnings.warn(ConvergenceWarning(f"d_optimal: {passes} passes and {open_.swaps} swaps, and the last pass still swapped", passes=passes, swaps=open_.swaps), stacklevel=2)
    return fill_remainder(found, resolved, "train")


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def support_points(vectors: DataFrame, labels: DataFrame | None = None, iterations: int = 500, tolerance: float = 1e-6, seed: int = 0, **sizes) -> DataFrame:
    """``id, partition``: test records nearest to the support points of the data (Mak and Joseph 2018), by fixed-point steps on the energy distance.

    ``labels``: ``id`` and numeric columns, which join the vectors.  The steps end when the energy falls by at most ``tolerance`` of itself.
    """
    resolved = resolve_sizes(vectors.count(), **sizes)
    k = resolved.test
    if labels is not None:
        extra = F.array(*[F.col(c).cast("double") for c in labels.columns if c != "id"])
        vectors = vectors.join(labels.select("id", extra.alias("y")), "id").select("id", F.concat("v", "y").alias("v"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        rng, n = np.random.default_rng(seed), len(x)
        lo, hi, energy = x.min(0), x.max(0), np.inf
        p = np.clip(x[rng.choice(n, k, replace=False)] + rng.normal(0, 1e-3, (k, x.shape[1])), lo, hi)
        for _ in range(iterations):
            # By blocks of points; the energy is that of the points before the step.
            to_x, apart, after = 0.0, 0.0, np.empty_like(p)
            for i in range(0, k, 256):
                part = slice(i, min(i + 256, k))
                own = np.arange(part.start, part.stop)
                a, b = np.sqrt(_gaps(p[part], x)), np.sqrt(_gaps(p[part], p))
                b[own - i, own] = 0
                to_x, apart = to_x + a.sum(), apart + b.sum()
                b[own - i, own] = np.inf
                pull, push = 1 / np.maximum(a, 1e-9), 1 / np.maximum(b, 1e-9)
                after[part] = np.clip((pull @ x + (p[part] * push.sum(1)[:, None] - push @ p) * n / k) / pull.sum(1)[:, None], lo, hi)
            before, energy = energy, 2 * to_x / (k * n) - apart / (k * k)
            if np.isfinite(before) and before - energy <= tolerance * abs(before):
                break
            p = after
        free, tested = np.ones(n, bool), []
        for row in p:
            i = int(np.where(free, ((x - row) ** 2).sum(1), np.inf).argmin())
            free[i] = False
            tested.append(i)
        part = np.full(n, None, dtype=object)
        part[tested] = "test"
        return pd.DataFrame({"id": pdf["id"], "partition": part})

    return fill_remainder(single_task(vectors, kernel, SPLIT, LINEAR), resolved, "test", seed)


def wasserstein(a: DataFrame, b: DataFrame) -> float:
    """The distance between two one-dimensional samples ``(d)``, from counts per distinct value."""
    both = a.select("d", F.lit(1.0).alias("x"), F.lit(0.0).alias("y")).unionByName(b.select("d", F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    per = running_shares(both.groupBy("d").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), "d", "x", "y")
    return per.agg(F.sum(F.abs(F.col("x") - F.col("y")) * (F.col("next") - F.col("d")))).first()[0] or 0.0


def mood(vectors: DataFrame, deployment: DataFrame, candidates: dict) -> tuple[str, dict[str, float], DataFrame]:
    """Of candidate splits, the one whose test-to-train distances are most like deployment-to-data ones.

    Returns its name, all scores, and its split; a candidate that cannot be made is left out, and
    if none can, the last reason is raised.
    """
    want = nearest(deployment, vectors)
    scores, splits, failed = {}, {}, ConfigurationError("no candidate split")
    for name, split in candidates.items():
        try:
            part = split(vectors)
        except SunderError as error:  # an infeasible candidate does not stop the others
            scores[name], failed = float("inf"), error
            continue
        side = lambda p: vectors.join(part.where(F.col("partition") == p).select("id"), "id", "left_semi")  # noqa: B023, E731
        scores[name] = wasserstein(nearest(side("test"), side("train")), want)
        splits[name] = part
    if not splits:
        raise failed
    best = min(splits, key=lambda k: (scores[k], k))
    return best, scores, splits[best]


def adversarial_auc(vectors: DataFrame, split: DataFrame, seed: int = 0) -> tuple[float, DataFrame]:
    """How well a logistic regression tells test from train (AUC), and ``id, p`` of each record."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    rows = vectors.join(split, "id").select("id", array_to_vector("v").alias("features"), (F.col("partition") == "test").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2))
    scored = None
    for k in (0, 1):
        model = LogisticRegression(maxIter=30, regParam=0.01).fit(rows.where(fold != k))
        one = model.transform(rows.where(fold == k))
        scored = one if scored is None else scored.unionByName(one)
    auc = BinaryClassificationEvaluator().evaluate(scored)
    return auc, scored.select("id", vector_to_array("probability")[1].alias("p"))


def adversarial(vectors: DataFrame, split: DataFrame, target_auc: float = 0.75, tolerance: float = 0.02, max_iter: int = 50, swap: float = 0.05, seed: int = 0) -> DataFrame:
    """``id, partition``: test records that look like train are swapped for train ones that look like test, until the AUC is met."""
    n_test = split.where("partition = 'test'").count()
    k, scratch = max(1, int(swap * n_test)), Scratch(vectors.sparkSession, "adversarial")
    for _ in range(max_iter):
        auc, p = adversarial_auc(vectors, split, seed)
        if abs(auc - target_auc) <= tolerance:
            return split.select("id", "partition")
        up = auc < target_auc
        scored = split.join(p, "id")
        out = value_rank(scored.where("partition = 'test'"), F.col("p"), "id", "pos", descending=not up).where(F.col("pos") < k).select("id", F.lit("train").alias("to"))
        into = value_rank(scored.where("partition = 'train'"), F.col("p"), "id", "pos", descending=up).where(F.col("pos") < k).select("id", F.lit("test").alias("to"))
        split = scratch.keep(split.join(out.unionByName(into), "id", "left").select("id", F.coalesce("to", "partition").alias("partition")))
    auc = adversarial_auc(vectors, split, seed)[0]
    if abs(auc - target_auc) > tolerance:
        warnings.warn(ConvergenceWarning(f"adversarial: an AUC of {auc:.3f} after {max_iter} rounds, not {target_auc}", auc=auc), stacklevel=2)
    return split.select("id", "partition")
