"""Splits by similarity: components, greedy clusterings, density, diversity picks."""

from __future__ import annotations

import heapq
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.errors import ConfigurationError, ConstraintError, ScalabilityError, SplitWarning
from sunder.functions.hashing import hash_key
from sunder.functions.sizes import Sizes, resolve_sizes
from sunder.plans.components import connected_components
from sunder.plans.distance import distance_sums, nearest, squared_distance_sums
from sunder.plans.farthest import FarthestFirst, FarthestPairs, Points
from sunder.plans.groups import assign_groups
from sunder.plans.independent import centres
from sunder.plans.kernels import neighbours, single_task
from sunder.plans.rank import hash_rank, value_rank
from sunder.plans.scratch import Scratch

MAX_KERNEL = 2_000_000  # records of a kernel that holds all vectors, but not their pairs


def fill_remainder(split: DataFrame, sizes: Sizes, picked: str, seed: int = 0) -> DataFrame:
    """``id, partition``: records without a partition are valid in hash order until that is full, then go to the side that was not picked for."""
    other = "test" if picked == "train" else "train"
    if not sizes.valid:
        return split.select("id", F.coalesce("partition", F.lit(other)).alias("partition"))
    split = Scratch(split.sparkSession, "remainder").keep(split.select("id", "partition"))
    rest = hash_rank(split.where("partition is null").select("id"), hash_key(seed, "remainder.permutation", 0, "id"), "id")
    part = F.when(F.col("pos") < sizes.valid, "valid").otherwise(other)
    return split.join(rest, "id", "left").select("id", F.coalesce("partition", part).alias("partition"))


def component_keys(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, key``: each record's component, itself without an edge."""
    scratch = Scratch(rows.sparkSession, "similar")
    comp = connected_components(edges, scratch)
    return rows.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("key"))


def shared_key_edges(df: DataFrame, id_col: str, keys: str, min_size: int = 2) -> DataFrame:
    """Edges that join all records that share any key: each to the smallest id with that key."""
    one = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.col(keys))).alias("k"))
    first = one.groupBy("k").agg(F.min("id").alias("b"), F.count("*").alias("c")).where(F.col("c") >= min_size)
    return one.join(first, "k").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def component_split(rows: DataFrame, edges: DataFrame, mode: str = "greedy_desc", check: bool = True, **sizes) -> DataFrame:
    """``id, partition, group``: no edge crosses partitions."""
    return assign_groups(component_keys(rows, edges), "id", F.col("key"), mode, check=check, **sizes)


def merged_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, key``: the finest groups that split no group of ``a(id, key)`` or ``b(id, key)``."""
    both = a.select("id", F.concat(F.lit("a"), F.col("key").cast("string")).alias("ka")).join(b.select("id", F.concat(F.lit("b"), F.col("key").cast("string")).alias("kb")), "id")
    keys = both.select("id", F.array_compact(F.array("ka", "kb")).alias("keys"))
    return component_keys(keys, shared_key_edges(keys, "id", "keys"))


def greedy_prune(split: DataFrame, edges: DataFrame, max_discard: float = 0.1, allow_discard: bool = True) -> DataFrame:
    """``id, partition``: test records with an edge to a train record are discarded, so that none is left.

    Train stays as it is, so each such record has to go whatever the order; more
    than a share ``max_discard`` of all records raises unless ``allow_discard``.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda p, c: split.where(F.col("partition") == p).select(F.col("id").alias(c))
    gone = both.join(side("test", "a"), "a", "left_semi").join(side("train", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
    gone = Scratch(split.sparkSession, "prune").keep(gone)
    if not allow_discard and gone.count() > int(max_discard * split.count()):
        raise ConstraintError("more records than max_discard are similar to train")
    out = split.join(gone.withColumn("gone", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("gone"), "discard").otherwise(F.col("partition")).alias("partition"))


def kept_edges(edges: DataFrame) -> DataFrame:
    """Edges that several steps read are computed once."""
    return edges if hasattr(edges, "_sunder_path") else Scratch(edges.sparkSession, "edges").keep(edges.select("a", "b"))


def degrees(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree``: neighbours without the record itself."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    return rows.select("id").join(ends, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree"))


def butina_keys(rows: DataFrame, edges: DataFrame, reorder: bool = False) -> DataFrame:
    """``id, key``: centres are visited by falling degree.

    With ``reorder`` degrees count free records only, and fall as clusters take theirs: each
    centre depends on those before it, so that one task visits them, under a ceiling.
    """
    edges = kept_edges(edges)
    if reorder:
        return single_task(rows.select("id"), _reordered, "id long, key long", 1_000_000, edges)
    return centres(degrees(rows, edges), edges, -F.col("degree")).select("id", F.col("centre").alias("key"))


def _reordered(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    ids = np.sort(pdf["id"].to_numpy())
    near = neighbours(ids, pairs)
    degree, key = [len(x) for x in near], np.full(len(ids), -1)
    queue = [(-d, i) for i, d in enumerate(degree)]
    heapq.heapify(queue)
    while queue:
        d, i = heapq.heappop(queue)
        if key[i] >= 0 or -d != degree[i]:
            continue  # taken, or counted anew since
        for j in [i, *(j for j in near[i] if key[j] < 0)]:
            key[j] = i
            for m in near[j]:
                if key[m] < 0:
                    degree[m] -= 1
                    heapq.heappush(queue, (-degree[m], m))
    return pd.DataFrame({"id": ids, "key": ids[key]})


def sphere_keys(rows: DataFrame, edges: DataFrame, seed: int | None = None) -> DataFrame:
    """``id, key``: centres are visited by id, or in hash order with a seed."""
    edges = kept_edges(edges)
    order = F.lit(0) if seed is None else hash_key(seed, "sphere_exclusion.order", 0, "id")
    return centres(rows, edges, order).select("id", F.col("centre").alias("key"))


def density_keys(rows: DataFrame, edges: DataFrame, min_samples: int = 5) -> DataFrame:
    """``id, key, noise``: DBSCAN; a border record joins its lowest cluster, noise is its own group."""
    scratch, edges = Scratch(rows.sparkSession, "density"), kept_edges(edges)
    core = scratch.keep(degrees(rows, edges).where(F.col("degree") + 1 >= min_samples).select("id"))
    end = lambda c: core.select(F.col("id").alias(c))
    inner = edges.select("a", "b").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi")
    of_core = scratch.keep(component_keys(core, inner))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    border = both.join(of_core.select(F.col("id").alias("b"), "key"), "b").groupBy("a").agg(F.min("key").alias("near"))
    out = rows.select("id").join(of_core, "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left")
    key = F.coalesce("key", "near")
    return out.select("id", F.coalesce(key, -F.col("id") - 1).alias("key"), key.isNull().alias("noise"))


def regroup_singletons(keys: DataFrame, policy: str, vectors: DataFrame | None = None) -> DataFrame:
    """``id, key``: clusters of one record stay (own_group), become one (shared_group) or join the nearest centre (nearest_cluster).

    Keys are the ids of centres, as the greedy clusterings give them.
    """
    if policy not in ("own_group", "shared_group", "nearest_cluster"):
        raise ConfigurationError(f"unknown policy {policy!r}")
    if policy == "own_group":
        return keys.select("id", "key")
    keys = Scratch(keys.sparkSession, "singletons").keep(keys.select("id", "key"))
    sizes = keys.groupBy("key").count()
    single = keys.join(sizes.where("count = 1"), "key", "left_semi")
    if policy == "shared_group":
        new = single.select("id", F.lit(single.agg(F.min("key")).first()[0]).alias("new"))
    else:
        centre = sizes.where("count > 1").select(F.col("key").alias("id"))
        if not centre.take(1):
            warnings.warn(SplitWarning("no cluster has two records: singletons stay"), stacklevel=2)
            return keys
        new = nearest(vectors.join(single, "id", "left_semi"), vectors.join(centre, "id", "left_semi")).select("id", F.col("nn").alias("new"))
    return keys.join(new, "id", "left").select("id", F.coalesce("new", "key").alias("key"))


def density_split(keys: DataFrame, noise_policy: str = "own_groups", vectors: DataFrame | None = None, **sizes) -> DataFrame:
    """``id, partition, group`` from ``density_keys``: where the noise goes.

    ``test``, ``train`` and ``discard`` set it aside while clusters are assigned,
    so sizes count clustered records; with ``distribute`` it joins the cluster of
    its nearest clustered record.
    """
    if noise_policy not in ("test", "train", "own_groups", "discard", "distribute"):
        raise ConfigurationError(f"unknown policy {noise_policy!r}")
    if noise_policy == "own_groups":
        return assign_groups(keys, "id", F.col("key"), check=False, **sizes)
    keys = Scratch(keys.sparkSession, "noise").keep(keys.select("id", "key", "noise"))
    kept, noise = keys.where("not noise"), keys.where("noise")
    if not kept.take(1):
        raise ConstraintError("all records are noise")
    if noise_policy == "distribute":
        near = nearest(vectors.join(noise, "id", "left_semi"), vectors.join(kept, "id", "left_semi"))
        moved = near.select("id", "nn").join(kept.select(F.col("id").alias("nn"), "key"), "nn").select("id", "key")
        return assign_groups(kept.select("id", "key").unionByName(moved), "id", F.col("key"), check=False, **sizes)
    out = assign_groups(kept, "id", F.col("key"), check=False, **sizes)
    return out.unionByName(noise.select("id", F.lit(noise_policy).alias("partition"), F.lit(None).cast("long").alias("group")))


def leave_one_cluster_out(keys: DataFrame, max_folds: int = 50, min_size: int = 1) -> DataFrame:
    """``id, fold``: clusters by falling size; those beyond the folds always train (fold -1)."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= min_size)
    # Only the largest max_folds clusters are ranked.
    top = sizes.orderBy(F.col("size").desc(), "first").limit(max_folds)
    folds = top.withColumn("fold", F.row_number().over(W.orderBy(F.col("size").desc(), "first")) - 1).select("key", "fold")
    return keys.join(F.broadcast(folds), "key", "left").select("id", F.coalesce("fold", F.lit(-1)).alias("fold"))


def _totals(vectors: DataFrame, squared: bool) -> DataFrame:
    return squared_distance_sums(vectors) if squared else distance_sums(vectors)


def minimal_test_dissimilarity(vectors: DataFrame, labels: DataFrame, squared: bool = False, **sizes) -> DataFrame:
    """``id, partition``: of each of n_test equal bins of falling label, the record with the least total distance tests.

    With ``squared``, squared distances are added: a surrogate without pairs, which orders records by their distance to the centroid.
    """
    resolved = resolve_sizes(vectors.count(), **sizes)
    rows = labels.select("id", "y").join(_totals(vectors, squared), "id")
    if resolved.valid:
        rows = Scratch(vectors.sparkSession, "minimal").keep(rows)
    test = _one_of_each_bin(rows, resolved.test)
    if not resolved.valid:
        return test.select("id", F.when(F.col("picked"), "test").otherwise("train").alias("partition"))
    # The same over the remainder gives valid.
    test = Scratch(vectors.sparkSession, "minimal").keep(test.select("id", "picked"))
    valid = _one_of_each_bin(rows.join(test.where("not picked"), "id", "left_semi"), resolved.valid).select("id", F.col("picked").alias("second"))
    part = F.when(F.col("picked"), "test").when(F.col("second"), "valid").otherwise("train")
    return test.join(valid, "id", "left").select("id", part.alias("partition"))


def _one_of_each_bin(rows: DataFrame, n_bins: int) -> DataFrame:
    """``id, picked``: of each of equal bins of falling label, the record with the least total."""
    size, longer = divmod(rows.count(), n_bins)
    ranked = value_rank(rows, F.col("y"), "id", descending=True)
    pos, edge = F.col("pos"), longer * (size + 1)
    bins = F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - edge) / max(size, 1)))
    nth = F.row_number().over(W.partitionBy("bin").orderBy("total", "id"))
    return ranked.select("id", bins.alias("bin"), "total").select("id", (nth == 1).alias("picked"))


def perimeter_outliers(vectors: DataFrame, squared: bool = False, **sizes) -> DataFrame:
    """``id, partition``: the records with the largest mean distance are tested; ``squared`` as in ``minimal_test_dissimilarity``."""
    resolved = resolve_sizes(vectors.count(), **sizes)
    ranked = value_rank(_totals(vectors, squared), F.col("total"), "id", descending=True)
    return fill_remainder(ranked.select("id", F.when(F.col("pos") < resolved.test, "test").alias("partition")), resolved, "test")


def _dense(vectors: DataFrame, kernel, *extra: str) -> DataFrame:
    """A kernel over all points, which is sequential by definition; guarded by its memory."""
    n = vectors.count()
    if n > MAX_KERNEL:
        raise ScalabilityError(f"{n} records are over the {MAX_KERNEL} of this kernel", n=n)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        return pd.DataFrame({"id": pdf["id"], "partition": kernel(Points(np.stack(pdf["v"].to_numpy())), pdf)})

    return vectors.select("id", "v", *extra, F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "id long, partition string")


def _max_min(points: Points, k: int, start: list[int]) -> list[int]:
    """Farthest-first: the record farthest from those picked comes next, the smallest index of equals."""
    picked, free = list(dict.fromkeys(start))[:k], np.ones(len(points), bool)
    free[picked] = False
    search = FarthestFirst(points, picked, free)
    while len(picked) < k:
        i = search.next()
        picked.append(i)
        free[i] = False
        search.add(i)
    return picked


def max_min(vectors: DataFrame, init: str = "index_zero", picked_goes_to: str = "train", seed: int = 0, swap_fraction: float = 0.0, **sizes) -> DataFrame:
    """``id, partition``: a farthest-first pick, the rest valid in hash order and then on the other side."""
    if not 0 <= swap_fraction < 1:
        raise ConfigurationError("swap_fraction lies in [0, 1)")
    if init not in ("index_zero", "kennard_stone", "most_peripheral", "random"):
        raise ConfigurationError(f"unknown start {init!r}")
    resolved = resolve_sizes(vectors.count(), **sizes)
    k = getattr(resolved, picked_goes_to)

    def kernel(points, pdf):
        start = [0]
        if init == "kennard_stone":
            start = list(points.farthest_pair())
        elif init == "most_peripheral":
            start = [int(points.totals().argmax())]
        elif init == "random":
            start = [int(np.random.default_rng(seed).integers(len(points)))]
        picked = _max_min(points, k, start)
        if swap_fraction:
            # Some picks go back for as many records that were not picked, both at random.
            rng, m = np.random.default_rng([seed, 1]), int(swap_fraction * k)
            rest = np.setdiff1d(np.arange(len(points)), picked)
            m = min(m, len(rest))
            back = rng.choice(k, m, replace=False)
            picked = np.concatenate((np.delete(picked, back), rng.choice(rest, m, replace=False)))
        out = np.full(len(points), None, dtype=object)
        out[picked] = picked_goes_to
        return out

    return fill_remainder(_dense(vectors, kernel), resolved, picked_goes_to, seed)


def seeded_growth(vectors: DataFrame, cutoff: float, seed_selection: str = "most_peripheral", **sizes) -> DataFrame:
    """``id, partition``: test grows from a seed by nearness; others within ``cutoff`` (squared distance) of it are discarded."""
    if seed_selection not in ("most_central", "most_peripheral"):
        raise ConfigurationError(f"unknown start {seed_selection!r}")
    resolved = resolve_sizes(vectors.count(), **sizes)
    k = max(1, resolved.test)

    def kernel(points, pdf):
        total = points.totals()
        i = int(total.argmin() if seed_selection == "most_central" else total.argmax())
        taken, near = np.zeros(len(points), bool), points.one(i)
        taken[i] = True
        for _ in range(k - 1):
            i = int(np.where(taken, np.inf, near).argmin())
            taken[i] = True
            near = np.minimum(near, points.one(i))
        return np.where(taken, "test", np.where(near > cutoff, None, "discard"))

    return fill_remainder(_dense(vectors, kernel), resolved, "test")


def perimeter_pairs(vectors: DataFrame, **sizes) -> DataFrame:
    """``id, partition``: the farthest pair of records left tests, until the test set is full; the rest as by ``fill_remainder``."""
    resolved = resolve_sizes(vectors.count(), **sizes)
    k = resolved.test

    def kernel(points, pdf):
        out, pairs, left = np.full(len(points), None, dtype=object), FarthestPairs(points, -1.0), k
        while left > 0:
            pair = list(pairs.next())[:left]
            out[pair], pairs.free[pair] = "test", False
            left -= len(pair)
        return out

    return fill_remainder(_dense(vectors, kernel), resolved, "test")


def spxy(vectors_with_label: DataFrame, **sizes) -> DataFrame:
    """``id, partition``: Kennard-Stone on the sum of scaled feature and label distances; input ``id, v, y``."""
    resolved = resolve_sizes(vectors_with_label.count(), **sizes)
    k = resolved.train

    def kernel(points, pdf):
        y = pdf["y"].to_numpy(float)
        i, j = points.farthest_pair()
        most_x = np.sqrt(max(float(points.one(i)[j]), 0.0))
        most_y = y.max() - y.min()
        wide_x, wide_y = most_x or 1, most_y or 1
        points.metric = lambda d, i, j: np.sqrt(np.maximum(d.astype(float), 0)) / wide_x + np.abs(y[i][:, None] - y[j]) / wide_y
        points.classes = np.unique(y, return_inverse=True)[1]
        # A pair that is to be the farthest has at least this squared distance, less what rounding may take.
        most = np.maximum(y - y.min(), y.max() - y) / wide_y * (1 + 1e-9)
        pair = points.farthest_pair_within(most, lambda rest: (np.maximum(rest, 0) * wide_x) ** 2 * (1 - 1e-9))
        out = np.full(len(points), None, dtype=object)
        out[_max_min(points, k, list(pair))] = "train"
        return out

    return fill_remainder(_dense(vectors_with_label, kernel, "y"), resolved, "train")


def duplex(vectors: DataFrame, **sizes) -> DataFrame:
    """``id, partition``: train and test each start at the farthest remaining pair and take turns farthest-first."""
    resolved = resolve_sizes(vectors.count(), **sizes)

    def kernel(points, pdf):
        n = len(points)
        pairs, out = FarthestPairs(points, 0.0), np.full(n, "train", dtype=object)
        free = pairs.free
        turns = [(p, k) for p, k in (("train", resolved.train), ("test", resolved.test), ("valid", resolved.valid)) if k]
        search: dict[str, FarthestFirst] = {}
        count = dict.fromkeys([p for p, _ in turns], 0)
        for p, k in turns:
            own = list(dict.fromkeys(pairs.next()))[:k]
            free[own], out[own], count[p] = False, p, len(own)
            search[p] = FarthestFirst(points, own, free)
        while free.any():
            for p, k in turns:
                if count[p] < k and free.any():
                    i = search[p].next()
                    free[i], out[i] = False, p
                    search[p].add(i)
                    count[p] += 1
        return out

    return _dense(vectors, kernel)


def max_dissimilarity(vectors: DataFrame, **sizes) -> DataFrame:
    """``id, partition``: of the farthest pair, test grows from the second by nearness, valid from what is farthest of the first."""
    resolved = resolve_sizes(vectors.count(), **sizes)

    def kernel(points, pdf):
        a, b = points.farthest_pair()
        order = np.argsort(points.one(b), kind="stable")
        order = np.concatenate(([b], order[(order != b) & (order != a)]))
        out = np.full(len(points), "train", dtype=object)
        out[order[: resolved.test]] = "test"
        rest = order[resolved.test :]
        out[rest[np.argsort(-points.one(a)[rest], kind="stable")][: resolved.valid]] = "valid"
        return out

    return _dense(vectors, kernel)
