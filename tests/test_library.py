"""Contracts, arithmetic, invariance, hand-made expectations and SQL twins of the library."""

import hashlib
import inspect
import itertools
import math
import random
import warnings
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sunder import cli, contract, queries, registry
from sunder.errors import ConfigurationError, ConstraintError, ConvergenceWarning, DegenerateGroupingError, EmptyPartitionError, InputError, MissingDependencyError, ParameterError, ScalabilityError, SizeToleranceWarning, UnknownOperatorError
from sunder.functions import features
from sunder.functions.sizes import floor_round, resolve_sizes
from sunder.operators import audit, baseline, embedding, lineage, pairs, property as prop, similarity as sim, structure, task
from sunder.plans.components import connected_components
from sunder.plans.distance import nearest, token_edges, token_links, vector_edges
from sunder.plans import farthest
from sunder.plans.farthest import Points, nearest_positions
from sunder.plans.groups import assign_folds, assign_groups, segments
from sunder.plans.independent import centres
from sunder.plans.kernels import NearestInside, balance, best_fronts, iterative_stratification, nsga2, single_task
from sunder.plans.layout import curve, fuzzy_graph, _WardMates, laplacian_vectors, nearest_rows, umap_layout, ward_labels
from sunder.plans.rank import hash_rank_within, value_rank
from sunder.plans.scratch import Scratch
from sunder.queries import ORACLE_SQL, QUERIES
from sunder.sources import tables
from sunder.streaming import rowlocal

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    fix = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(fix(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(cols)
    assert canonical(ours.select(*[f"`{c}`" for c in cols]).collect(), cols) == canonical(theirs.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_keep_the_contract(spark, name):
    out = QUERIES[name](spark, DATA)
    rows = out.collect()
    assert rows
    if "partition" in out.columns:
        assert len({r.id for r in rows}) == len(rows) and {r.partition for r in rows} <= set(contract.PARTITIONS)
        assert {"train", "test"} <= {r.partition for r in rows}


@given(st.integers(2, 5000), st.floats(0.05, 0.6), st.floats(0.0, 0.3))
@settings(max_examples=200, deadline=None)
def test_sizes_sum(n, test, valid):
    try:
        s = resolve_sizes(n, None, valid, test)
    except EmptyPartitionError:
        return
    assert s.total == n and s.test == floor_round(test * n) and s.train >= 1


def test_sizes_by_hand():
    assert resolve_sizes(10) == resolve_sizes(10, 0.8, 0.0, 0.2)
    s = resolve_sizes(7, 0.5, None, 0.5)
    assert (s.train, s.valid, s.test) == (3, 0, 4)
    assert floor_round(2.5) == 3
    for bad in ({"test": 0}, {"test": True}, {"test": 1.5}, {"train": 5, "valid": 5, "test": 5}):
        with pytest.raises(ConfigurationError):
            resolve_sizes(10, **bad)


def test_partitioning_changes_nothing(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    for f in (
        lambda d: baseline.random_split(d, "o_orderkey", seed=3),
        lambda d: assign_groups(d, "o_orderkey", F.col("o_custkey")),
        lambda d: prop.property_split(d, "o_orderkey", "o_totalprice"),
    ):
        a, b = (sorted(f(orders.repartition(k)).collect()) for k in (1, 7))
        assert a == b


def test_contract_and_json(spark):
    split = baseline.random_split(spark.range(50), "id", shuffle=False)
    assert contract.assert_split(split, 50) == {"train": 40, "valid": 0, "test": 10, "discard": 0}
    text = contract.to_json(split, "random", {"seed": 0})
    assert '"train":[[0,39]]' in text and sorted(contract.from_json(spark, text).collect()) == sorted(split.collect())
    with pytest.raises(InputError):
        contract.assert_split(split.unionByName(split), 50)
    with pytest.raises(InputError):
        contract.from_json(spark, "{}")


def test_groups_by_hand(spark):
    keys = ["a"] * 5 + ["b"] * 3 + ["c"] * 2
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    out = {r.id: (r.partition, r.group) for r in assign_groups(df, "id", F.col("k"), test=0.5, valid=0.0).collect()}
    assert [out[i] for i in (0, 5, 8)] == [("train", 0), ("test", 1), ("test", 2)]
    folds = {r.group: r.fold for r in assign_folds(df, "id", F.col("k"), 2).collect()}
    assert folds == {0: 0, 1: 1, 2: 1}
    with pytest.raises(DegenerateGroupingError):
        assign_groups(df.withColumn("k", F.lit("x")), "id", F.col("k"))


@pytest.mark.parametrize("seed", range(3))
def test_components_and_centres_by_brute_force(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(45)})
    e = spark.createDataFrame(edges, "a long, b long")
    comp = list(range(n))
    for _ in range(n):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.node: x.component for x in connected_components(e, Scratch(spark, "t")).collect()}
    assert got == {i: comp[i] for i in {x for ab in edges for x in ab}}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    prio = {i: (i * 7919) % 61 for i in range(n)}
    owner = {}
    for i in sorted(range(n), key=lambda i: (prio[i], i)):
        if i not in owner:
            owner[i] = i
            for j in near[i]:
                owner.setdefault(j, i)
    rows = spark.createDataFrame([(i, prio[i]) for i in range(n)], "id long, p long")
    assert {x.id: x.centre for x in centres(rows, e, F.col("p")).collect()} == owner


def test_distances_by_brute_force(spark):
    r = random.Random(1)
    vec = [(i, [float(r.randint(0, 6)) for _ in range(3)]) for i in range(50)]
    df = spark.createDataFrame(vec, "id long, v array<double>")
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    expected = {(i, j, d(x, y)) for (i, x), (j, y) in itertools.combinations(vec, 2) if d(x, y) <= 6}
    assert {tuple(x) for x in vector_edges(df, 6.0).collect()} == expected
    q, ref = df.where("id < 20"), df.where("id >= 20")
    assert {x.id: (x.d, x.nn) for x in nearest(q, ref).collect()} == {i: min((d(x, y), j) for j, y in vec[20:]) for i, x in vec[:20]}
    sets = [(i, [f"t{r.randint(0, 9)}" for _ in range(r.randint(0, 8))]) for i in range(40)]
    found = {(x.a, x.b) for x in token_edges(spark.createDataFrame(sets, "id long, t array<string>"), "id", "t", 6, 10).collect()}
    assert found == {(i, j) for (i, x), (j, y) in itertools.combinations(sets, 2) if x and y and 10 * len(set(x) & set(y)) >= 6 * len(set(x) | set(y))}


def test_metrics(spark):
    rows = [([1, 0], [3, 0]), ([0, 0], [0, 0]), ([5, 1], [4, 1])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.select(*[features.METRICS[m](F.col("a"), F.col("b")).alias(m) for m in ("tanimoto", "dice")]).collect()
    assert [x.tanimoto for x in got] == pytest.approx([0.5, 0.0, 1 / 3]) and [x.dice for x in got] == pytest.approx([1 / 3, 0.0, 0.2])
    real = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    out = real.select(*[features.METRICS[m](F.col("a"), F.col("b")).alias(m) for m in ("cosine", "euclidean", "manhattan", "tanimoto_count")]).collect()
    assert [x.cosine for x in out] == pytest.approx([1.0, 0.0, 0.0], abs=1e-12) and out[0].euclidean == 5.0 and out[0].manhattan == 7.0
    assert [x.tanimoto_count for x in out] == pytest.approx([1.0, 0.0, 0.5])
    bits = spark.createDataFrame([("a b c d",), (None,)], "t string").select(features.pack(features.shingle_bits(F.col("t"))).alias("p")).collect()
    assert sum(bin(x & (1 << 64) - 1).count("1") for x in bits[0].p) == 2 and not any(bits[1].p)


def test_ties_and_buffers(spark):
    df = tables.label_extremes(spark)
    keep = prop.property_split(df, "id", "y", "low_test", "keep_together", test=0.5, valid=0.0)
    tested = {r.id for r in keep.where("partition = 'test'").collect()}
    assert tested >= set(range(60))
    for seed in (0, 1):
        out = prop.property_split(df, "id", "y", "low_test", "random", seed, test=0.5, valid=0.0)
        assert out.where("partition = 'test'").count() == 50
    near = prop.label_extrapolation(df, "id", "y", buffer=3, test=0.1, valid=0.1)
    assert {r.partition: r["count"] for r in near.groupBy("partition").count().collect()}["discard"] == 3


def test_lineage(spark):
    assert [lineage.offset_days(x) for x in ("30D", "4W", "3M", "1Y", 5)] == [30, 28, 90, 365, 5]
    df = tables.dated_series(spark)
    out = lineage.temporal(df, "id", "date")
    met = out.join(df, "id").groupBy("partition").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()
    by = {r.partition: r for r in met}
    assert by["train"].hi <= by["test"].lo
    src = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b"), (5, "b")], "id long, s string")
    with pytest.warns(UserWarning):
        out = {r.id: r.partition for r in lineage.source_split(src, "id", "s", test=0.4, valid=0.0).collect()}
    assert out[2] == out[3] and out[4] == out[5]


def test_cold_pairs(spark):
    df = tables.interactions(spark)
    out = pairs.assign_pairs(df, "id", F.col("compound"), F.col("target")).join(df, "id")
    train, test = (out.where(F.col("partition") == p) for p in ("train", "test"))
    for c in ("compound", "target"):
        assert train.join(test, c, "left_semi").count() == 0


def test_kernels():
    y = np.array([[1, 0], [1, 0], [0, 1], [0, 1], [np.nan, 0], [0, 0], [1, 1], [0, 0]], float)
    fold = iterative_stratification(y, [4, 0, 4], np.zeros((8, 3)))
    assert (fold == 0).sum() == 4 == (fold == 2).sum()
    item = np.array([[5.0], [4], [3], [3], [3]])
    at = balance(item, np.array([0.5, 0.5]))
    assert abs(item[at == 0].sum() - 9) <= 0
    big = np.random.default_rng(0).integers(1, 9, (40, 3)).astype(float)
    at = balance(big, np.array([0.6, 0.2, 0.2]))
    assert abs(big[at == 1].sum() / big.sum() - 0.2) < 0.05


def test_umap(spark):
    a, b = curve(0.1)  # the published fit
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.005))
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (40, 8)) for c in (0, 12, 24)])
    near, d = nearest_rows(x, 15, "euclidean")
    full = np.linalg.norm(x[:, None] - x[None], axis=-1) + np.diag(np.full(120, np.inf))
    assert (near == np.argsort(full, 1, kind="stable")[:, :15]).all() and np.allclose(d, np.sort(full, 1)[:, :15])
    i, j, w = fuzzy_graph(near, d)
    assert (i < j).all() and (w > 0).all() and (w <= 1).all() and set(i // 40 - j // 40) == {0}
    y = umap_layout(x, np.random.default_rng(0))
    assert np.isfinite(y).all() and len(set(zip(ward_labels(y, 3), np.repeat([0, 1, 2], 40), strict=True))) == 3
    same = umap_layout(np.ones((20, 4)), np.random.default_rng(0), n_epochs=20)
    assert np.isfinite(same).all()
    sets = (rng.random((30, 40)) < 0.3).astype(float)
    sets[0] = 0  # an empty set is at distance 1 from all others
    both, either = sets @ sets.T, np.maximum(sets[:, None], sets[None]).sum(-1)
    far = 1 - both / np.maximum(either, 1) + np.diag(np.full(30, np.inf))
    assert np.allclose(nearest_rows(sets, 5, "jaccard")[1], np.sort(far, 1)[:, :5])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    assert embedding.umap_keys(rows.limit(0)).count() == 0
    keys = embedding.umap_keys(rows, n_clusters=3).orderBy("id").collect()
    again = embedding.umap_keys(rows.repartition(5), n_clusters=3).orderBy("id").collect()
    assert keys == again and [r.key for r in keys] == sorted(r.key for r in keys)


@pytest.mark.parametrize("k", [1, 2, 5, 12, 15])
def test_ward(k):
    p = np.random.default_rng(k).normal(size=(12, 2))
    parts = [[i] for i in range(12)]
    while len(parts) > k:
        cost = lambda u, v: len(u) * len(v) / (len(u) + len(v)) * ((p[u].mean(0) - p[v].mean(0)) ** 2).sum()
        u, v = min(itertools.combinations(parts, 2), key=lambda c: cost(*c))
        parts = [z for z in parts if z is not u and z is not v] + [sorted(u + v)]
    assert {frozenset(z) for z in parts} == {frozenset(np.flatnonzero(ward_labels(p, k) == c)) for c in range(min(k, 12))}


def test_guards(spark):
    with pytest.raises(ScalabilityError):
        baseline.k_fold(spark.range(10_001), "id", 0)
    with pytest.raises(MissingDependencyError):
        embedding.projection(None, method="tsne")
    for wrong in ({"n_neighbors": 1}, {"min_dist": -1.0}, {"metric": "hamming"}, {"n_clusters": 0}):
        with pytest.raises(ConfigurationError):
            embedding.umap_keys(None, **wrong)
    with pytest.raises(UnknownOperatorError, match="butina"):
        registry.get("butinna")
    assert registry.get("Butina").id == "butina" and len(registry.OPERATORS) == 64
    assert registry.table(spark, "task").count() == 8


def test_clusters_stay_apart(spark):
    rows = tables.two_clusters(spark)
    out = task.hi(rows.select("id"), vector_edges(rows.select("id", "v"), 16.0), test=0.5, valid=0.0)
    met = out.join(rows.withColumnRenamed("group", "g"), "id").groupBy("g").agg(F.count_distinct("partition").alias("k")).collect()
    assert {r.k for r in met} == {1}
    keys = sim.density_keys(rows.select("id"), vector_edges(rows.select("id", "v"), 16.0))
    assert keys.select("key").distinct().count() == 2


def test_audit(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", 4.0), (4, None, 5.0)], "id long, k string, y double")
    split = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train"), (4, "test")], "id long, partition string")
    assert [tuple(r) for r in audit.duplicates_across(df, "id", "k", split).collect()] == [(2, 1)]
    assert tuple(audit.shared_groups(df, "id", "k", split).first()) == (2, 1, 1)
    assert audit.ks_statistic(df, "id", "y", split).first().ks == pytest.approx(0.5)
    assert audit.property_shift(df, "id", "y", split).first().cohens_d == pytest.approx(1 / math.sqrt(4.5))
    assert [r.key for r in audit.aggregate_replicates(df, "id", "k", "y", "drop_conflicting").where("key is not null").collect()] == ["y"]


def test_stream_equals_batch(spark, tmp_path):
    spark.range(200).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    both = lambda df: rowlocal.by_date(rowlocal.bernoulli(df, "id").withColumnRenamed("partition", "p"), "d", "2020-05-01", 7)
    q = both(stream).writeStream.format("memory").queryName("rowlocal").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("rowlocal").collect()) == sorted(both(batch).collect())
    assert 20 < both(batch).where("p = 'test'").count() < 60


def sequential_places(sizes, rooms):
    """Each group in turn to the place with most room, the first of equals."""
    rooms, out = list(rooms), []
    for m in sizes:
        at = max(range(len(rooms)), key=lambda b: (rooms[b], -b))
        rooms[at] -= m
        out.append(at)
    return out, rooms


@given(st.lists(st.integers(1, 60), min_size=1, max_size=5), st.lists(st.integers(0, 300), min_size=2, max_size=5))
@settings(max_examples=300, deadline=None)
def test_places_by_size_equal_the_sequential_fold(sizes, rooms):
    for size in sizes:
        for m in (1, 2, 7, 40):
            parts, left = segments(rooms, size, m)
            want, after = sequential_places([size] * m, rooms)
            got = [cycle[(k - start) % len(cycle)] for start, stop, cycle in parts for k in range(start, stop)]
            assert got == want and left == after and len(parts) <= 6 * len(rooms) + 6


def test_group_placement_equals_the_sequential_fold(spark):
    r = random.Random(3)
    rows = [(k, r.choice([f"big{r.randint(0, 3)}", f"mid{r.randint(0, 30)}", f"one{k}"])) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(5)
    size, first = {}, {}
    for i, k in rows:
        size[k], first[k] = size.get(k, 0) + 1, min(first.get(k, i), i)
    order = sorted(size, key=lambda k: (-size[k], first[k]))
    s = resolve_sizes(700, None, 0.1, 0.2)
    places, _ = sequential_places([size[k] for k in order], [s.train, s.valid, s.test])
    want = {k: ("train", "valid", "test")[p] for k, p in zip(order, places, strict=True)}
    got = {x.id: x.partition for x in assign_groups(df, "id", F.col("k"), train=None, valid=0.1, test=0.2).collect()}
    assert got == {i: want[k] for i, k in rows}
    places, _ = sequential_places([size[k] for k in order], [700 / 7] * 7)
    folds = dict(zip(order, places, strict=True))
    assert {x.id: x.fold for x in assign_folds(df, "id", F.col("k"), 7).collect()} == {i: folds[k] for i, k in rows}
    rank = {k: n for n, k in enumerate(order)}
    assert {x.id: x.fold for x in assign_folds(df, "id", F.col("k"), auto=True).collect()} == {i: rank[k] for i, k in rows}


def test_ranks_of_common_values(spark):
    """A value that most rows share is cut by the id; ranks are exact all the same."""
    r = random.Random(1)
    rows = [(k, 5.0 if r.random() < 0.7 else r.choice([1.0, 2.0, float(r.randint(0, 9))]), f"s{min(2, r.randint(0, 9))}") for k in range(900)]
    df = spark.createDataFrame(rows, "id long, v double, s string").repartition(6)
    for down in (False, True):
        want = {i: n for n, (i, *_) in enumerate(sorted(rows, key=lambda x: (-x[1] if down else x[1], x[0])))}
        assert {x.id: x.pos for x in value_rank(df, F.col("v"), "id", descending=down).collect()} == want
    out = hash_rank_within(df, "s", F.md5(F.col("id").cast("string")), "id").collect()
    by = {}
    for x in out:
        by.setdefault(x.s, []).append(x)
    for stratum in by.values():
        assert [x.pos for x in sorted(stratum, key=lambda x: hashlib.md5(str(x.id).encode()).hexdigest())] == list(range(len(stratum)))
        assert {x.size for x in stratum} == {len(stratum)}


def test_valid_is_honoured_by_the_pickers(spark):
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in r.normal(size=3)], float(k % 7)) for k in range(100)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, y double")
    sizes = {"train": 0.7, "valid": 0.1, "test": 0.2}
    for f in (
        lambda: sim.max_min(vectors, **sizes), lambda: sim.max_min(vectors, picked_goes_to="test", swap_fraction=0.3, **sizes), lambda: sim.spxy(vectors, **sizes), lambda: sim.perimeter_pairs(vectors, **sizes),
        lambda: sim.perimeter_outliers(vectors, **sizes), lambda: sim.minimal_test_dissimilarity(vectors, vectors, **sizes), lambda: embedding.d_optimal(vectors, n_components=2, **sizes),
        lambda: embedding.support_points(vectors, iterations=5, **sizes), lambda: sim.duplex(vectors, **sizes), lambda: sim.max_dissimilarity(vectors, **sizes),
    ):
        counts = {x.partition: x["count"] for x in f().groupBy("partition").count().collect()}
        assert counts == {"train": 70, "valid": 10, "test": 20}
    grown = {x.partition: x["count"] for x in sim.seeded_growth(vectors, 0.3, **sizes).groupBy("partition").count().collect()}
    assert grown["test"] == 20 and grown["valid"] == 10


def test_token_edges_of_equal_sets(spark):
    """Copies, empty sets and ties: pairs and links agree with brute force."""
    r = random.Random(4)
    sets = [r.sample("abcdefghij", r.randint(0, 6)) for _ in range(60)]
    sets += [list(x) for x in sets[:15]] * 2
    df = spark.createDataFrame(list(enumerate(sets)), "id long, t array<string>").repartition(3)
    want = set()
    for (i, x), (j, y) in itertools.combinations(enumerate(map(set, sets)), 2):
        if x and y and len(x & y) * 10 >= 7 * len(x | y):
            want.add((i, j, len(x & y), len(x), len(y)))
    assert {tuple(x) for x in token_edges(df, "id", "t", 7, 10).collect()} == want
    ids = df.select("id")
    assert sorted(sim.component_keys(ids, token_links(df, "id", "t", 7, 10)).collect()) == sorted(sim.component_keys(ids, token_edges(df, "id", "t", 7, 10)).collect())


def test_vector_edges_meet_only_near_blocks(spark, monkeypatch):
    from sunder.plans import distance

    monkeypatch.setattr(distance, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(size=(60, 3)), r.normal(size=(60, 3)) + 40, np.zeros((5, 3))))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 1.0}
    assert {(e.a, e.b) for e in vector_edges(df, 1.0).collect()} == want
    assert vector_edges(df.limit(0), 1.0).collect() == []


def test_registry_runs_operators_alike(spark):
    docs = spark.createDataFrame([(k, f"k{k % 12}", [float(k % 5), float(k % 3), 1.0], ["a", f"w{k % 9}"], float(k)) for k in range(120)], "id long, k string, v array<double>, t array<string>, y double")
    for name, columns, more in (
        ("random", (), {}), ("stratified_random", "k", {}), ("property", "y", {}), ("protein_family", "k", {}), ("murcko_scaffold", "k", {}), ("similarity_threshold", "t", {}),
        ("max_min", "v", {}), ("butina", "v", {"cutoff": 1000.0}), ("k_means_cluster", "v", {}), ("cold_pair", ("k", "t[1]"), {}), ("source", "k", {}), ("opti_sim", "v", {"radius": 10.0, "n_picks": 6}),
    ):
        out = registry.split(name, docs, "id", columns, train=None, valid=0.0, test=0.25, **more)
        assert out.count() == 120 and {"train", "test"} <= {x.partition for x in out.select("partition").distinct().collect()}, name
    inner = registry.splitter("random", "id", test=0.5)
    from sunder.operators import protocol

    three = protocol.three_way(docs, "id", registry.splitter("protein_family", "id", "k"), inner)
    assert {x.partition for x in three.select("partition").distinct().collect()} == {"train", "valid", "test"}
    assert registry.splitter("random", "id")(docs, 3).collect() != registry.splitter("random", "id")(docs, 4).collect()
    for bad in (("hi", ()), ("butina", "v"), ("protein_family", ())):
        with pytest.raises(ParameterError):
            registry.split(bad[0], docs, "id", bad[1])
    assert registry.table(spark).where("takes = 'frame'").count() > 10


def test_butina_with_reordering(spark):
    r = random.Random(6)
    n = 50
    pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(90)})
    rows, edges = spark.range(n), spark.createDataFrame(pairs, "a long, b long")
    free, want = set(range(n)), {}
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    while free:
        i = min(free, key=lambda k: (-len(near[k] & free), k))
        for j in {i} | (near[i] & free):
            want[j] = i
        free -= {j for j in want}
    assert {x.id: x.key for x in sim.butina_keys(rows, edges, reorder=True).collect()} == want


def test_forced_discards_and_label_clusters(spark):
    df = spark.createDataFrame([(k, k % 6, float(k // 10) * 100 + k % 3) for k in range(60)], "id long, k long, y double")
    out = {x.id: (x.partition, x.group) for x in assign_groups(df, "id", F.col("k"), discarded=F.col("k") == 0, test=0.2).collect()}
    assert {i for i, (p, _) in out.items() if p == "discard"} == {k for k in range(60) if k % 6 == 0} and sum(p == "test" for p, _ in out.values()) == 10
    assert {g for p, g in out.values() if p != "discard"} == {0, 1, 2, 3, 4}
    strata = {}
    for x in baseline.strata(df, "id", "y", 6, "kmeans").collect():
        strata.setdefault(x.stratum, set()).add(x.id // 10)
    assert len(strata) == 6 and all(len(v) == 1 for v in strata.values())


def test_structure_operators_refuse(spark):
    rows = spark.createDataFrame([(k, float(k + 1), "" if k % 2 else "s") for k in range(20)], "id long, y double, s string")
    with pytest.raises(DegenerateGroupingError):
        structure.substructure(rows, "id", [F.col("y") > 0])
    none = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    with pytest.raises(ConstraintError):
        structure.activity_cliff(rows, none)
    with pytest.raises(ConstraintError):
        structure.scaffold_split(rows, "id", "s", "raise")
    out = structure.scaffold_split(rows, "id", "s", "shared_group", check=False, test=0.5).collect()
    assert len({x.group for x in out}) == 2
    assert len({x.group for x in structure.scaffold_split(rows, "id", "s", "own_group", check=False).collect()}) == 11
    # A unit that begins in test is whole there; valid comes next.
    edges = spark.createDataFrame([(0, 9), (9, 19), (1, 15)], "a long, b long")
    part = {x.id: x.partition for x in structure.activity_cliff(rows, edges, fold_change=2.0, scale="linear", train=None, valid=0.1, test=0.2).collect()}
    assert {part[k] for k in (0, 9, 19, 1, 15)} == {"test"} and sorted(part.values()).count("valid") == 2
    assert {x.partition for x in structure.activity_cliff(rows, edges, fold_change=2.0, scale="linear", keep_partners=False).collect()} == {"train", "test"}


@pytest.mark.parametrize(("fold_change", "scale"), [(1.5, "linear"), (1.0, "linear"), (2.0, "log")])
def test_cliff_links_join_what_all_pairs_join(spark, fold_change, scale):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(12)]
    texts = [base[: 12 - int(k)] + [f"x{int(j)}"] * int(j > 3) for k, j in zip(rng.integers(0, 4, 60), rng.integers(0, 6, 60), strict=True)]
    rows = [(k, float(rng.choice([1.0, 1.2, 1.6, 2.5])), t + [f"g{k % 5}", f"h{k % 5}"]) for k, t in enumerate(texts)] + [(60, None, texts[0]), (61, 1.0, [])]
    rows = spark.createDataFrame(rows, "id long, y double, words array<string>")
    labelled = rows.where("y is not null")
    pairs = structure.cliff_pairs(labelled, token_edges(labelled, "id", "words", 8, 10), fold_change, scale)
    links = structure.cliff_links(rows, "words", 8, 10, fold_change, scale)
    parts = lambda edges: {(x.node, x.component) for x in connected_components(edges, Scratch(spark, "t")).collect()}
    want = parts(pairs)
    assert len(want) > 20 and parts(links) == want


def test_cliff_links_do_not_pair_copies(spark):
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 30.0).otherwise(10.0).alias("y"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    links = structure.cliff_links(rows, "words", 8, 10, 2.0, "linear")
    assert links.count() == 899
    out = structure.activity_cliff(rows.select("id", "y"), None, links=links)
    assert {x.partition for x in out.collect()} == {"test"}
    with pytest.raises(ConfigurationError):
        structure.activity_cliff(rows, links, links=links)
    out = structure.activity_cliff(rows.select("id", "y"), None, links=links, target="balanced").collect()
    assert {x.partition for x in out} == {"train"}  # one unit of all records


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "in.parquet")
    spark.range(40).withColumn("k", F.col("id") % 4).write.parquet(path)
    out = str(tmp_path / "s.json")
    assert cli.main(["split", path, out, "--id", "id", "--operator", "protein_family", "--column", "k", "--test", "0.25"]) == 0
    assert cli.main(["audit", path, out, "--id", "id", "--key", "k", "--fail-on", "shared"]) == 0
    assert cli.main(["split", path, out, "--id", "id"]) == 0
    assert cli.main(["audit", path, out, "--id", "id", "--key", "k", "--fail-on", "shared"]) == 4
    assert cli.main(["split", path, out, "--id", "id", "--operator", "nothing"]) == 2
    assert cli.main(["list", "--json"]) == 0 and "butina" in capsys.readouterr().out


def test_corpus_operators_are_optional(tmp_path):
    """The entry works without the corpus subpackage and the pipeline."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(cli.__file__).parent.parent
    shutil.copytree(root / "sunder", tmp_path / "sunder", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'random' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_running_shares_and_ks(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(size=3000), 2)
    part = np.where(rng.random(3000) < 0.3, "test", "train")
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)] + [(3000, None)], "id long, y double")
    split = spark.createDataFrame([(k, str(p)) for k, p in enumerate(part)] + [(3000, "test")], "id long, partition string")
    a, b = np.sort(y[part == "train"]), np.sort(y[part == "test"])
    at = np.unique(y)
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert audit.ks_statistic(df, "id", "y", split).first().ks == pytest.approx(want)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "d double")
    grid = np.linspace(0, 1, 200_001)[:-1] + 2.5e-6
    quantile = lambda x: x[(grid * len(x)).astype(int)]
    assert embedding.wasserstein(frame(a), frame(b)) == pytest.approx(np.abs(quantile(a) - quantile(b)).mean(), abs=1e-4)
    assert audit.ks_p_value(0.0, 10, 10) == 1.0 and audit.ks_p_value(1.3581 / 50, 5000, 5000) == pytest.approx(0.05, abs=1e-3)
    assert audit.ks_p_value(0.9, 500, 500) < 1e-9


def test_histogram_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.99, 1.0, 1.5, None)], "d double")
    got = {r.bin: r.n for r in audit.histogram(df, bins=4).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}
    assert audit.histogram(df.limit(0), bins=2).agg(F.sum("n")).first()[0] == 0


def _points(spark, points):
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "id long, v array<double>")


def test_mahalanobis(spark):
    x = np.random.default_rng(5).normal(size=(60, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 3, 0.1]])
    got = np.stack([r.v for r in embedding.whitened(_points(spark, x)).orderBy("id").collect()])
    inverse = np.linalg.inv(np.cov(x.T))
    for i, j in ((0, 1), (5, 40), (17, 59)):
        assert np.linalg.norm(got[i] - got[j]) == pytest.approx(math.sqrt((x[i] - x[j]) @ inverse @ (x[i] - x[j])))
    flat = embedding.whitened(_points(spark, [(1, 2), (1, 3), (1, 5)]))
    assert {len(r.v) for r in flat.collect()} == {1}


def test_audit_flags_a_leak(spark):
    points = [(k, 1) for k in range(40)]
    rows = _points(spark, points)
    split = spark.createDataFrame([(k, "test" if k % 4 == 0 else "train") for k in range(40)], "id long, partition string")
    records = rows.select("id", F.lit("same").alias("key"), F.lit("s").alias("source"), F.col("v")[0].alias("y"), F.when(F.col("id") % 4 == 0, 10.0 + F.col("id") % 3).otherwise(F.col("id") % 3).alias("p"))
    report = audit.audit_split(rows, split, records, key="key", source="source", label="y", properties=("p", "y"), auc=lambda v, s: 0.5)
    assert (report["n_train"], report["n_test"], report["n_duplicates"], report["shared_source"]) == (30, 10, 10, 1)
    assert report["flags"] == ["EXACT_DUPLICATES_ACROSS_PARTITIONS", "HIGH_MAX_SIMILARITY", "MEDIAN_NN_ABOVE_0.6", "SHARED_SOURCES", "LOW_ADVERSARIAL_AUC", "SMALL_TEST", "PROPERTY_SHIFT_p"]
    assert audit.flags({"n_test": 30}) == []
    with pytest.raises(EmptyPartitionError):
        audit.audit_split(rows, split.where("partition = 'train'"))


def test_scramble_control(spark):
    rows = spark.createDataFrame([(k, [float(k)], float(k % 7)) for k in range(70)], "id long, v array<double>, y double")
    split = spark.createDataFrame([(k, "test" if k >= 60 else "train") for k in range(70)], "id long, partition string")
    again = audit.scrambled(rows, 0, 0)
    assert sorted(r.y for r in again.collect()) == sorted(r.y for r in rows.collect())
    assert [r.y for r in again.orderBy("id").collect()] != [r.y for r in rows.orderBy("id").collect()]
    right = lambda train, test: -float(train.select(F.sum(F.abs(F.col("y") - F.col("v")[0] % 7))).first()[0])
    out = audit.scramble_control(rows, split, right, n_repeats=3)
    assert out["passes"] and out["p_value"] == 0 and len(out["scrambled_scores"]) == 3
    assert not audit.scramble_control(rows, split, lambda train, test: 1.0, n_repeats=2)["passes"]


def test_growth_and_farthest_pairs(spark):
    line = _points(spark, [(x,) for x in (0, 1, 2, 3, 10, 11, 20, 21, 30, 31)])
    parts = lambda df: "".join({"train": "r", "test": "e", "discard": "d"}[r.partition] for r in df.orderBy("id").collect())
    assert parts(sim.perimeter_pairs(line, test=4)) == "eerrrrrree"
    assert parts(sim.perimeter_pairs(line, test=3)) == "eerrrrrrre"
    assert parts(sim.seeded_growth(line, 4.0, test=2)) == "rrrrrrrree"
    assert parts(sim.seeded_growth(line, 100.0, test=2)) == "rrrrrrddee"
    with pytest.raises(ConfigurationError):
        sim.seeded_growth(line, 1.0, "nowhere")


def test_noise_policies(spark):
    keys = spark.createDataFrame([(0, 0, False), (1, 0, False), (2, 2, False), (3, 2, False), (4, -5, True)], "id long, key long, noise boolean")
    rows = _points(spark, [(0,), (1,), (10,), (11,), (12,)])
    for policy in ("test", "train", "discard"):
        got = {r.id: r.partition for r in sim.density_split(keys, policy, test=0.5).collect()}
        assert got[4] == policy and got[0] == got[1] != got[2] == got[3]
    got = {r.id: r.partition for r in sim.density_split(keys, "distribute", rows, test=0.5).collect()}
    assert got[4] == got[3] and len(got) == 5
    assert {r.id for r in sim.density_split(keys).collect()} == set(range(5))


def test_merged_groups_and_pruning(spark):
    key = lambda *k: spark.createDataFrame(list(enumerate(k)), "id long, key string")
    got = {r.id: r.key for r in sim.merged_keys(key("x", "x", "y", None, "z"), key("p", "q", "q", None, "r")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    split = spark.createDataFrame([(0, "train"), (1, "test"), (2, "test")], "id long, partition string")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert {r.id: r.partition for r in sim.greedy_prune(split, edges).collect()} == {0: "train", 1: "discard", 2: "test"}
    with pytest.raises(Exception, match="max_discard"):
        sim.greedy_prune(split, edges, allow_discard=False)


def test_synthetic_parties(spark):
    df = spark.range(4000).withColumn("y", F.col("id") % 3)
    got = lineage.synthetic_parties(df, "id", 3, "y", alpha=0.3)
    shares = got.join(df, "id").groupBy("y", "party").count().collect()
    assert got.count() == 4000 and {r.party for r in shares} == {0, 1, 2}
    assert max(r["count"] for r in shares) > 600  # skewed: a third of a level is 444
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lineage.synthetic_parties(df.repartition(7), "id", 3, "y", alpha=0.3).collect()))
    with pytest.raises(ConfigurationError):
        lineage.synthetic_parties(df, "id", 1)


def _largest_first(keys, capacity):
    """``{id: side}`` and ``{id: group}`` by brute force; ``keys``: id to key."""
    ids = {}
    for i in sorted(keys):
        ids.setdefault(keys[i], []).append(i)
    filled, side = [0] * len(capacity), {}
    for k in sorted(ids, key=lambda k: (-len(ids[k]), ids[k][0])):
        at = min(range(len(capacity)), key=lambda b: (filled[b] - capacity[b], b))
        filled[at] += len(ids[k])
        side |= dict.fromkeys(ids[k], at)
    group = {k: g for g, k in enumerate(sorted(ids, key=lambda k: ids[k][0]))}
    return side, {i: group[k] for i, k in keys.items()}


def test_entities_are_not_folded(spark, tmp_path):
    rng = random.Random(5)
    # Keys that agree modulo 300, 25, 701 or 211 are different entities.
    drugs, targets = [1, 301, 601, 2, 302, 7, 307], [1, 26, 51, 2, 27, 3]
    both = sorted({(rng.choice(drugs), rng.choice(targets)) for _ in range(30)})
    spark.createDataFrame(both, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    bought = {k: rng.choice([1, 212, 423, 702, 913, 2, 213, 703]) for k in range(60)}
    spark.createDataFrame(list(bought.items()), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: {r.id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    a, b = ({x * 100000 + y: (x, y)[k] for x, y in both} for k in (0, 1))
    n, side = len(both), ("train", "test")
    n_test = floor_round(0.2 * n)
    for name, keys in (("cold_drug_entities", a), ("cold_target_entities", b)):
        part, group = _largest_first(keys, [n - n_test, n_test])
        assert {i: (r.partition, r.group) for i, r in run(name).items()} == {i: (side[part[i]], group[i]) for i in keys}
    axis_test = round((n_test / n) ** 0.5 * n)
    x, y = (_largest_first(keys, [n - axis_test, axis_test])[0] for keys in (a, b))
    assert {i: r.partition for i, r in run("cold_pair_entities").items()} == {i: side[x[i]] if x[i] == y[i] else "discard" for i in a}
    assert {i: r.partition for i, r in run("complex_joint_entities").items()} == {i: side[x[i] | y[i]] for i in a}
    part, group = _largest_first(bought, [48, 12])
    assert {i: (r.partition, r.group) for i, r in run("group_assignment_entities").items()} == {i: (side[part[i]], group[i]) for i in bought}
    part, group = _largest_first(bought, [20, 20, 20])
    assert {i: (r.fold, r.group) for i, r in run("group_k_fold_entities").items()} == {i: (part[i], group[i]) for i in bought}


def test_d_optimal_ends_where_no_swap_helps(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_exponential((300, 6)).round(6)
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    with warnings.catch_warnings():
        warnings.simplefilter("error", ConvergenceWarning)
        out = {r.id: r.partition for r in embedding.d_optimal(rows, train=0.5, valid=0.0, test=0.5).collect()}
    x = (v - v.mean(0)) / v.std(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    z = np.hstack([np.ones((300, 1)), (u * s)[:, :5]])
    inside = np.array([out[i] == "train" for i in range(300)])
    assert inside.sum() == 150
    info = z[inside].T @ z[inside] + 1e-8 * np.eye(6)
    base = np.linalg.slogdet(info)[1]
    for i in np.flatnonzero(inside):
        less = info - np.outer(z[i], z[i])
        for j in np.flatnonzero(~inside):
            assert np.linalg.slogdet(less + np.outer(z[j], z[j]))[1] <= base + 1e-9
    start = np.argsort(-(z * z).sum(1), kind="stable")[:150]
    assert embedding.fedorov_exchange(z, start, 1e-8, 100)[2] > 20
    with pytest.warns(ConvergenceWarning):
        embedding.d_optimal(rows, passes=1, train=0.5, valid=0.0, test=0.5)


def test_distances_are_added_not_their_squares(spark, monkeypatch):
    from sunder.plans import distance

    monkeypatch.setattr(distance, "BLOCK", 16)
    rng = np.random.default_rng(3)
    # A tight cluster and a long tail; the last two are equal vectors.
    v = np.vstack([rng.normal(0, 1, (50, 3)), rng.exponential(9, (20, 3)) ** 1.5]).round()
    v[69] = v[68]
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    total = {r.id: r.total for r in distance.distance_sums(rows.repartition(5)).collect()}
    assert [total[i] for i in range(70)] == pytest.approx(d.sum(1)) and total[68] == total[69]
    tested = lambda out: {r.id for r in out.collect() if r.partition == "test"}
    rank = lambda t: sorted(range(70), key=lambda i: (-round(t[i], 6), i))
    assert tested(sim.perimeter_outliers(rows, test=35)) == set(rank(d.sum(1))[:35]) != set(rank((d**2).sum(1))[:35])
    y = spark.createDataFrame([(i, float(i % 7)) for i in range(70)], "id long, y double")
    order = sorted(range(70), key=lambda i: (-(i % 7), i))
    best = lambda t: {min(order[5 * k : 5 * k + 5], key=lambda i: (round(t[i], 6), i)) for k in range(14)}
    assert tested(sim.minimal_test_dissimilarity(rows, y, test=14)) == best(d.sum(1)) != best((d**2).sum(1))


def test_searches_run_at_the_reference_size(monkeypatch):
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert (default(task.ave_split, "population"), default(task.ave_split, "generations")) == (200, 150)
    assert default(embedding.support_points, "iterations") == 500 and default(embedding.adversarial, "max_iter") == 50
    seen = {}
    stand_in = lambda name: lambda *a, **b: seen.update({name: b})
    for module, f in ((task, "ave_split"), (embedding, "som_keys"), (embedding, "adversarial"), (embedding, "support_points")):
        monkeypatch.setattr(module, f, stand_in(f))
    for name in ("_vectors", "_labels", "_t"):
        monkeypatch.setattr(queries, name, lambda *a: MagicMock())
    monkeypatch.setattr(baseline, "random_split", lambda *a: None)
    for name in ("ave", "self_organizing_map", "adversarial", "support_points"):
        QUERIES[name](None, "")
    assert seen == {"ave_split": {}, "som_keys": {}, "adversarial": {}, "support_points": {}}


def test_support_points_settle_and_see_labels(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(120, 2)))], "id long, v array<double>")
    tested = lambda *a, **b: {r.id for r in embedding.support_points(rows, *a, **b).collect() if r.partition == "test"}
    assert tested(iterations=2000) == tested() and len(tested()) == 24
    y = spark.createDataFrame([(i, float(rng.exponential())) for i in range(120)], "id long, y double")
    assert tested(y) != tested()


def test_links_between_seven_and_nine_tenths(spark, tmp_path):
    names = [(1, "abcdefghij"), (2, "abcdefghxy"), (3, "zzzzzzzzzz"), (4, "klmnopqrst"), (5, "klmnopqxyz")]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    group = {r.id: r.group for r in QUERIES["sequence_identity_7"](spark, str(tmp_path)).collect()}
    # 8 of 10 places is a link, 7 of 10 is not.
    assert group[1] == group[2] and len({group[k] for k in (1, 3, 4, 5)}) == 4


def test_copies_of_sequences_are_linked_once(spark):
    names = ["abcdefghij", "abcdefghiX", "zzzzzzzzzz"]
    rows = spark.createDataFrame([(i, names[i % 3]) for i in range(60)], "id long, s string")
    edges = [tuple(r) for r in task.sequence_edges(rows, "id", "s", 8, 10).collect()]
    # 57 copies and one pair of different sequences; all pairs of copies would be 970.
    assert len(edges) == 58 and (0, 1) in edges and len(set(edges)) == 58
    keys = {r.id: r.key for r in sim.component_keys(rows, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(k == (2 if i % 3 == 2 else 0) for i, k in keys.items())


def _picked(monkeypatch, f, x, y=None, **sizes):
    """What a picker's kernel gives for points, and their distances; over the ceiling of the time when a kernel held all pairs."""
    kernels = []
    table = MagicMock()
    table.count.return_value = len(x)
    monkeypatch.setattr(sim, "_dense", lambda v, kernel, *extra: kernels.append(kernel))
    monkeypatch.setattr(sim, "fill_remainder", lambda *a: None)
    f(table, **sizes)
    assert sim.MAX_KERNEL > 1_000_000
    square = (x * x).sum(1)
    return list(kernels[0](sim.Points(x), pd.DataFrame({"id": range(len(x)), "y": y if y is not None else 0}))), square[:, None] + square[None] - 2 * (x @ x.T)


def _cloud(n=400):
    return np.floor(np.random.default_rng(n).normal(size=(n, 3)) * 9)


def test_duplex_without_all_pairs(monkeypatch):
    out, d = _picked(monkeypatch, sim.duplex, _cloud())
    free, sets = set(range(400)), {"train": [], "test": []}
    for p in sets:
        pair = max(((i, j) for i in free for j in free), key=lambda t: (d[t], -t[0], -t[1]))
        sets[p] += pair
        free -= set(pair)
    while free:
        for p, k in (("train", 320), ("test", 80)):
            if free and len(sets[p]) < k:
                i = max(free, key=lambda i: (d[i, sets[p]].min(), -i))
                sets[p].append(i)
                free.discard(i)
    assert {i for i, p in enumerate(out) if p == "test"} == set(sets["test"])


def test_max_dissimilarity_without_all_pairs(monkeypatch):
    out, d = _picked(monkeypatch, sim.max_dissimilarity, _cloud())
    a, b = divmod(int(np.triu(d, 1).argmax()), 400)
    order = [b, *[int(i) for i in np.argsort(d[b], kind="stable") if i not in (a, b)]]
    assert {i for i, p in enumerate(out) if p == "test"} == set(order[:80])


def test_max_min_without_all_pairs(monkeypatch):
    out, d = _picked(monkeypatch, sim.max_min, _cloud())
    picked = [0]
    while len(picked) < 320:
        near = d[picked].min(axis=0)
        near[picked] = -1
        picked.append(int(near.argmax()))
    assert {i for i, p in enumerate(out) if p == "train"} == set(picked)


def test_perimeter_pairs_without_all_pairs(monkeypatch):
    out, d = _picked(monkeypatch, sim.perimeter_pairs, _cloud())
    free, tested = set(range(400)), []
    while len(tested) < 80:
        pair = max(((i, j) for i in free for j in free if i != j), key=lambda t: (d[t], -t[0], -t[1]))
        tested += pair
        free -= set(pair)
    assert {i for i, p in enumerate(out) if p == "test"} == set(tested)


def test_seeded_growth_without_all_pairs(monkeypatch):
    out, d = _picked(monkeypatch, lambda v: sim.seeded_growth(v, 40.0), _cloud())
    taken = [int(d.sum(axis=1).argmax())]
    while len(taken) < 80:
        near = d[taken].min(axis=0)
        near[taken] = np.inf
        taken.append(int(near.argmin()))
    near = d[taken].min(axis=0)
    assert out == ["test" if i in taken else None if near[i] > 40 else "discard" for i in range(400)]


def test_spxy_without_all_pairs(monkeypatch):
    y = np.random.default_rng(1).integers(0, 10, 400)
    out, d = _picked(monkeypatch, sim.spxy, _cloud(), y)
    both = np.sqrt(d) / np.sqrt(d).max() + np.abs(y[:, None] - y[None]) / (y.max() - y.min())
    picked = list(divmod(int(both.argmax()), 400))
    while len(picked) < 320:
        near = both[picked].min(axis=0)
        near[picked] = -1
        picked.append(int(near.argmax()))
    assert {i for i, p in enumerate(out) if p == "train"} == set(picked)


def test_decoys_are_matched_without_their_pairs(spark):
    rng = np.random.default_rng(2)
    actives, pool = ([(int(i), float(p), float(s)) for i, (p, s) in enumerate(zip(rng.integers(0, 12, n) / 4, rng.integers(0, 4, n), strict=True))] for n in (40, 900))
    used, want = set(), []
    for a, p, s in actives:
        near = sorted((sum(((x - y) / t) ** 2 for x, y, t in ((q, p, 0.5), (r, s, 1.0))), d) for d, q, r in pool if abs(q - p) <= 0.5 and abs(r - s) <= 1 and d not in used)[:30]
        used |= {d for _, d in near}
        want += [(a, d) for _, d in near]
    frame = lambda rows: spark.createDataFrame(rows, "id long, p double, s double")
    assert sorted(map(tuple, task.matched_decoys(frame(actives), frame(pool), {"p": 0.5, "s": 1.0}, 30).collect())) == sorted(want)
    # 3,000 actives and 3,000 decoys alike: 9,000,000 pairs, over the former ceiling of 5,000,000.
    alike = spark.range(3000).selectExpr("id", "1.0D as p", "1.0D as s")
    assert task.matched_decoys(alike, alike, {"p": 0.5, "s": 1.0}, 30).count() == 3000


def test_scaffold_hop_needs_no_pairs(spark):
    x = np.random.default_rng(4).integers(0, 20, (90, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 7 if i % 11 else None, i % 5 > 0) for i in range(90)], "id long, v array<double>, scaffold long, active boolean")
    edges = spark.createDataFrame([(i, j) for i in range(90) for j in range(i) if ((x[i] - x[j]) ** 2).sum() <= 9], "a long, b long")
    by_pairs, by_vectors = (sorted(task.scaffold_hop(rows.drop("v"), **k).collect()) for k in ({"edges": edges}, {"vectors": rows.select("id", "v"), "cutoff": 9.0}))
    assert by_pairs == by_vectors
    part = {r.id: r.partition for r in by_pairs}
    near = lambda i, j: i != j and ((x[i] - x[j]) ** 2).sum() <= 9
    for i in range(90):
        if part[i] == "test" and i % 5 > 0:
            assert any(near(i, j) and part[j] == "train" and j % 5 > 0 for j in range(90))


def test_one_component_is_placed_as_by_the_sql(spark):
    rows = spark.range(20)
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)], "a long, b long")
    with pytest.raises(ConstraintError):
        task.hi(rows, edges)
    with pytest.warns(SizeToleranceWarning):
        assert {(r.partition, r.group) for r in task.hi(rows, edges, empty="keep").collect()} == {("train", 0)}


def test_one_component_is_placed_by_the_search(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(19)], "a long, b long")
    with pytest.warns(SizeToleranceWarning):
        assert {(r.partition, r.group) for r in task.hi(spark.range(20), edges, solver="search", empty="keep").collect()} == {("train", 0)}


def test_nearest_inside_by_brute_force():
    rng = np.random.default_rng(6)
    x, active = np.floor(rng.normal(size=(300, 4)) * 50), rng.random(300) < 0.4
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    search = NearestInside(x, active)
    for share in (0.2, 0.5, 0.97):
        test = rng.random(300) < share
        for wanted in (True, False):
            inside = ~test & (active == wanted)
            if inside.any():
                assert (search(np.flatnonzero(test), inside, wanted) == d[test][:, inside].min(axis=1)).all()


def test_lo_takes_neighbours_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(15)
    pairs = sorted({tuple(sorted(rng.choice(60, 2, replace=False).tolist())) for _ in range(150)})
    y, near = rng.integers(0, 4, 60).astype(float), [{b if a == i else a for a, b in pairs if i in (a, b)} for i in range(60)]
    free, tested = set(range(60)), set()
    while True:
        order = sorted((i for i in free if len(near[i] & free) >= 4), key=lambda i: (-len(near[i] & free), i))
        found = next((m for i in order if np.std(y[sorted(m := {i} | (near[i] & free))]) >= 0.6), None)
        if found is None:
            break
        tested |= found
        free -= found
    leaks = {j for i in tested for j in near[i]} - tested
    rows, edges = spark.createDataFrame([(i, float(y[i])) for i in range(60)], "id long, y double"), spark.createDataFrame(pairs, "a long, b long")
    calls = []
    monkeypatch.setattr(task, "single_task", lambda df, kernel, schema, ceiling, *other: calls.append(other) or single_task(df, kernel, schema, ceiling, *other))
    got = {r.id: r.partition for r in task.lo(rows, edges).collect()}
    assert calls == [()] and got == {i: "test" if i in tested else "discard" if i in leaks else "train" for i in range(60)}


def _ceiling(monkeypatch, f):
    seen = []
    monkeypatch.setattr(embedding, "fill_remainder", lambda *a: None)
    monkeypatch.setattr(embedding, "Scratch", MagicMock())
    monkeypatch.setattr(embedding, "single_task", lambda df, kernel, schema, ceiling, *other: seen.append(ceiling))
    table = MagicMock()
    table.count.return_value = 100
    f(table)
    return seen[0]


def test_spectral_vectors_without_a_dense_matrix(monkeypatch):
    x = np.floor(np.random.default_rng(11).normal(size=(2100, 3)) * 100)
    near = nearest_positions(Points(x), 12)
    d = ((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (x @ x.T))
    assert (near == np.argsort(d, axis=1, kind="stable")[:, 1:13]).all()
    a = np.zeros_like(d)
    a[np.arange(2100)[:, None], near] = 1
    a = np.maximum(a, a.T)
    root = 1 / np.sqrt(a.sum(1))
    want, got = np.linalg.eigh(np.eye(2100) - root[:, None] * a * root[None])[1][:, 1:5], laplacian_vectors(near, 4)
    assert np.abs((want * got).sum(0)) == pytest.approx(1, abs=1e-6)
    assert _ceiling(monkeypatch, embedding.spectral_keys) > 1_000_000


def test_support_points_by_blocks(spark, monkeypatch):
    rows = spark.range(5001).selectExpr("id", "array(double(id % 71), double(id % 13)) as v")
    out = embedding.support_points(rows, iterations=1, test=300).groupBy("partition").count().collect()
    assert {r.partition: r["count"] for r in out} == {"train": 4701, "test": 300}


def test_d_optimal_takes_all_records(monkeypatch):
    assert _ceiling(monkeypatch, embedding.d_optimal) > 1_000_000


def test_opti_sim_takes_all_records(monkeypatch):
    assert _ceiling(monkeypatch, lambda v: embedding.opti_sim(v, 1.0, 5)) > 1_000_000


def test_self_organizing_map_takes_all_records(monkeypatch):
    assert _ceiling(monkeypatch, embedding.som_keys) > 1_000_000


def test_umap_cluster_takes_all_records(monkeypatch):
    assert _ceiling(monkeypatch, embedding.umap_keys) > 1_000_000


def test_fronts_and_several_aims():
    value = np.array([[0, -9], [-9, 0], [-1, -1], [-2, -2], [-1, -5], [-4, -1.5]], float)
    assert set(best_fronts(value, 3)) == {0, 1, 2} and set(best_fronts(value, 2)) == {0, 1}
    x = np.random.default_rng(24).normal(size=(80, 2))
    aims = lambda m: -((x[m].mean(0) - x[~m].mean(0) - [0.5, -0.3]) ** 2)
    best = nsga2(80, 16, aims, np.random.default_rng(0), 40, 60)
    assert best.sum() == 16 and aims(best).min() > -0.01


def test_simpd_has_the_aims_of_the_method(spark):
    x = np.random.default_rng(21).normal(size=(60, 3)) * 900
    rows = spark.createDataFrame([(i, [float(v) for v in np.floor(x[i])], float(i % 4), i % 9) for i in range(60)], "id long, v array<double>, y double, key long")
    found = task.time_like(rows.select("id", "v"), rows.select("id", "y"), clusters=rows.select("id", "key"), population=20, generations=5, train=None, valid=0.1, test=0.2).groupBy("partition").count().collect()
    assert {r.partition: r["count"] for r in found} == {"train": 42, "valid": 6, "test": 12}
    with pytest.raises(ConfigurationError):
        task.time_like(rows.select("id", "v"), rows.select("id", "y"), {"delta_weight": 0.1})


def test_simpd_takes_all_records(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(task, "Scratch", MagicMock())
    monkeypatch.setattr(task, "single_task", lambda df, kernel, schema, ceiling, *other: seen.append(ceiling))
    table = MagicMock()
    table.count.return_value, table.columns = 100, ["id", "y"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        task.time_like(table, table, clusters=table)
    assert seen == [1_000_000]


def test_nearest_columns_and_least_are_those_of_all_entries():
    rng = np.random.default_rng(5)
    for d in (rng.integers(0, 40, (30, 900)).astype(float), rng.random((7, 23)), np.zeros((3, 50))):
        at, value = farthest.nearest_columns(d, 5)
        assert (at == np.argsort(d, axis=1, kind="stable")[:, :5]).all() and (value == np.take_along_axis(d, at, 1)).all()
    x, y = rng.integers(0, 30, (400, 6)).astype(float), rng.integers(0, 4, 400).astype(float)
    points = Points(x, lambda d, i, j: np.sqrt(d.astype(float)) / 50 + np.abs(y[i][:, None] - y[j]) / 3)
    want = points.between(np.arange(400))
    points.classes = y.astype(int)
    assert (points.least(np.arange(9), np.arange(100, 300)) == want[:9, 100:300].min(axis=1)).all()
    # Few of the pairs are worked out.
    seen, metric = [], points.metric
    points.metric = lambda d, i, j: seen.append(d.size) or metric(d, i, j)
    most = np.maximum(y, 3 - y) / 3
    pair = points.farthest_pair_within(most, lambda rest: (np.maximum(rest, 0) * 50) ** 2 * (1 - 1e-9))
    assert pair == tuple(int(k) for k in divmod(int(want.argmax()), 400)) and sum(seen) < 400 * 400 / 5


def test_ward_mates_look_at_few_clusters():
    x = np.random.default_rng(6).normal(size=(4000, 2))
    mates, seen = _WardMates(x), []
    cost = mates.cost
    mates.cost = lambda i, j: seen.append(len(j)) or cost(i, j)
    for i in range(0, 4000, 400):
        d = ((x - x[i]) ** 2).sum(1) / 2
        d[i] = np.inf
        assert mates.nearest(i)[0] == int(d.argmin())
    assert sum(seen) < 10 * 4000 / 2


def test_map_is_trained_record_by_record(spark):
    x = np.random.default_rng(7).normal(size=(70, 3))
    rng, w = np.random.default_rng(0), None
    w = x[rng.integers(0, 70, 16)] + rng.normal(0, 1e-3, (16, 3))
    at, step = np.stack(np.divmod(np.arange(16), 4), axis=1), 0
    for _ in range(2):
        for i in rng.permutation(70):
            left = 1 - step / 140
            best, reach = int(((x[i] - w) ** 2).sum(1).argmin()), max(0.5, 2 * left)
            w = w + (0.5 * left * np.exp(-((at - at[best]) ** 2).sum(1) / (2 * reach * reach)))[:, None] * (x[i] - w)
            step += 1
    want = ((x[:, None] - w[None]) ** 2).sum(-1).argmin(1)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.key for r in embedding.som_keys(rows, grid=4, epochs=2).collect()}
    assert [got[k] for k in range(70)] == want.tolist()


def test_lists_of_neighbours_are_packed():
    ids = np.array([-3, 2, 5, 9, 2**40])
    pdf = pd.DataFrame({"id": [2, 5], "near": [np.array([2**40, -3, 7, 9]), np.array([2])]})
    packed = next(task._packed([pdf]))
    lists = task._Lists(ids, pd.Series([packed["near"][0], None, packed["near"][1]]))
    assert [lists[k].tolist() for k in range(3)] == [[0, 3, 4], [], [1]]
    far = next(task._packed([pd.DataFrame({"id": [0], "near": [np.arange(0, 90_000, 90)]})]))["near"][0]
    assert len(far) < 8 * 1000 / 4
