"""Targets and pivotal rounding."""

from collections import Counter

import numpy as np
import pytest

from sunder.llm import mixing
from tests.llm.helpers import DOCS, corpus, words


def targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = corpus(seed, 300)
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs.repartition(6)).collect()
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    by_id = {r[0]: r for r in rows}
    sizes, taken, largest = {}, {}, {}
    for r in out:
        s = by_id[r.doc_id][3]
        assert r.size == len(words(by_id[r.doc_id][1])) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[by_id[r.doc_id][3]] and abs(r.target - want[by_id[r.doc_id][3]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_pivot_keeps_means_and_words():
    sizes = [3, 10, 5, 8, 1, 7]
    share = np.array([0.3, 0.6, 0.5, 0.2, 0.9, 0.4])
    mean, totals = np.zeros(6), []
    for seed in range(4000):
        p, held = mixing.pivot(list(range(6)), sizes, share, seed, 0)
        assert all(x in (0.0, 1.0) for k, x in enumerate(p) if k != held)
        totals.append(p @ sizes)
        mean += p
    assert np.allclose(totals, share @ sizes)
    assert np.abs(mean / 4000 - share).max() < 0.03


def test_mix_repeated_and_null_ids(spark, monkeypatch):
    """Rows are documents of their own; equal ones share their copies evenly; partitioning changes nothing."""
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(None if k % 3 == 0 else k // 7, t, *x) for k, (_, t, *x) in enumerate(corpus(3, 200))]
    rows += rows[:12] * 5
    docs = spark.createDataFrame(rows, DOCS)
    outs = [sorted(map(repr, mixing.mix_sources(docs.repartition(n)).collect())) for n in (1, 3, 8)]
    assert outs[0] == outs[1] == outs[2]
    out = mixing.mix_sources(docs).collect()
    key = lambda i, text: (i, len(words(text)))
    assert Counter((r.doc_id, r.size) for r in out) == Counter(key(r[0], r[1]) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    # The mix itself has the same copies.
    mixed = mixing.mixed_rows(docs.repartition(5)).collect()
    assert sum(r.taken for r in out) == sum(len(words(r.text)) for r in mixed) and {(r.doc_id, r.text) for r in mixed} <= {(r[0], r[1]) for r in rows}
    for r in mixed:
        taken[r.carry.source] += len(words(r.text))
    assert mixing.mixed_rows(docs, carry=("lang",)).first().carry.asDict().keys() == {"source", "lang"}
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= max(len(words(r[1])) for r in rows if r[3] == s)


def test_mix_edges(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    assert mixing.mixed_rows(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, "x", None, 0), (1, "a b", "x", None, 0), (1, "a b", "x", None, 0), (None, "a", "x", "s", 0), (2, "w " * 200_000, "x", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 size", "2 share", "3 bucket", "4 h", "5 kid", "6 th", "7 times")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 5 and all(r.taken <= 2 * r.size for r in out)
