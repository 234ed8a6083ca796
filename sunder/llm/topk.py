"""Exact top-k search by a three-phase uniform threshold.

Cao and Wang, "Efficient Top-K Query Calculation in Distributed Networks"
(2004).  A score is the sum of partial scores over slices of the components.

1. Every block of candidates is dealt to tiles of rows near each other.  For each
   query, the tile that can hold the highest scores gives, slice by slice, the entries
   with the highest partial scores.  Their full scores are gathered; the k-th
   highest of a query over all blocks is a safe cutoff, since k rows reach it.
2. The cutoff goes back to all blocks.  Tiles whose bound (their centre's score and their
   radius) is below it are skipped.  In the others slices are added one by one; an
   entry stays while a slice of it reaches, or may reach, cutoff / m, and while its sum and the
   norms of the slices to come can reach the cutoff.
3. Entries that stay are sufficient: their remaining slices are resolved, for them
   alone once they are few, and those that reach the cutoff compete, ties going to the smaller id.

Queries and candidates meet in blocks of bounded size, so neither side is ever
broadcast or gathered; a block returns at most k rows of a query.  Scores are
integers.  They are computed as floats where no sum can leave the 53 bits that
a float holds exactly, and else as Python integers, without bounds; a score beyond a long is
held at its bounds before rows compete.

Defined cases: rows with a null id, a null vector, or a vector with a null or
non-finite component take no part; rows with the same id are rows of their own: each is a
candidate for the others, and a query of its own; rows equal in id and vector are computed once and counted;
vectors of different lengths are not compared; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.plans.scratch import Scratch

SCALE = 1024
QUERY_BLOCK, ROW_BLOCK, TILE = 2048, 8192, 256
FEW = 0.2  # share of a tile's entries below which they are resolved one by one
LONG = (1 << 63) - 1


def scaled(table: pa.Table, name: str) -> np.ndarray:
    """The vectors of a table of equal lengths: floor(1024 * x), as floats if exact, else as Python integers."""
    column = table.column(name).combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    if not flat.size or np.abs(flat).max() < 2.0**40:
        return np.floor(flat * SCALE)
    return np.array([[math.floor(x) * SCALE + math.floor((x - math.floor(x)) * SCALE) for x in row] for row in flat.tolist()], dtype=object)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if their inner products are exact so, else as Python integers."""
    if q.dtype != object and c.dtype != object:
        bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) * 8
        if bound < 2.0**53:
            return q, c
    as_int = lambda a: a if a.dtype == object else np.array([[int(x) for x in row] for row in a.tolist()], dtype=object).reshape(a.shape)
    return as_int(q), as_int(c)


def _slices(dim: int, m: int) -> list[slice]:
    cut = [dim * k // m for k in range(m + 1)]
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row, k positions with the highest values."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.array([sorted(range(len(r)), key=lambda i: -r[i])[:k] for r in scores.tolist()])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _norms(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """Norm of each slice of each row, a little too large rather than too small."""
    return np.stack([np.sqrt((x[:, s] ** 2).sum(axis=1)) for s in cuts], axis=1) * (1 + 1e-9) + 1e-3


class _Meet:
    """A block of queries and a block of rows, these dealt to tiles."""

    def __init__(self, queries: pa.Table, rows: pa.Table, m: int):
        q, c = _exact(scaled(queries, "embedding"), scaled(rows, "r_embedding"))
        self.q_ids, self.q_keys = queries.column("vec_id").to_numpy(), queries.column("vh").to_numpy()
        ids, keys, times = (rows.column(f"r_{x}").to_numpy() for x in ("vec_id", "vh", "times"))
        self.cuts = _slices(q.shape[1], m)
        self.bounded = q.dtype != object and len(c) > 0
        place = np.zeros(len(c), np.int64)
        if self.bounded:
            n = max(1, len(c) // TILE)
            start = c[np.argsort(keys, kind="stable")[:n]]
            place = (c @ start.T - (start * start).sum(axis=1) / 2).argmax(axis=1)
        order = np.lexsort((ids, place))
        self.c, self.ids, self.keys, self.times, place = c[order], ids[order], keys[order], times[order], place[order]
        self.q = q
        self.tiles = []
        for a in np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(c) else []:
            end = int(np.searchsorted(place, place[a], "right"))
            self.tiles += [slice(k, min(end, k + TILE)) for k in range(int(a), end, TILE)]
        if self.bounded:
            self.q_norms, self.c_norms = _norms(q, self.cuts), _norms(self.c, self.cuts)
            centre = np.stack([self.c[t].mean(axis=0) for t in self.tiles])
            radius = np.array([np.sqrt(((self.c[t] - x) ** 2).sum(axis=1)).max() for t, x in zip(self.tiles, centre, strict=True)])
            whole = np.sqrt((q * q).sum(axis=1))
            self.bounds = (q @ centre.T + np.outer(whole, radius)) * (1 + np.sign(q @ centre.T) * 1e-9) + 1

    def part(self, who: np.ndarray, tile: slice, s: slice) -> np.ndarray:
        """Partial scores of some queries and a tile's rows."""
        x, y = self.q[who][:, s], self.c[tile][:, s]
        return x @ y.T if s.stop > s.start else np.zeros((len(x), len(y)))

    def copies(self, r: int, at: np.ndarray) -> np.ndarray:
        """How often rows are candidates for query ``r``: all but the query itself."""
        own = (self.ids[at] == self.q_ids[r]) & (self.keys[at] == self.q_keys[r])
        return self.times[at] - own


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores within the bounds of a long."""
    if scores.dtype != object:
        return scores
    return np.array([max(-LONG - 1, min(LONG, x)) for x in scores.tolist()], dtype=object)


def _emit(meet: _Meet | None, rows: list) -> pa.Table:
    """Of (query, row or -1, score): the query's and the row's id, and the score."""
    r, c, score = zip(*rows, strict=True) if rows else ((), (), ())
    r, c = np.array(r, np.int64), np.array(c, np.int64)
    ids = lambda x: x if meet is not None else np.zeros(0, np.int64)
    return pa.table(
        {
            "query_id": pa.array(ids(meet and meet.q_ids)[r]),
            "vh": pa.array(ids(meet and meet.q_keys)[r]),
            "vec_id": pa.array(np.where(c < 0, 0, ids(meet and meet.ids)[c]) if len(c) else c),
            "score": pa.array([int(x) for x in score], pa.int64()),
        }
    )


def _gather(k: int, m: int):
    """Phase 1: per query, the k best full scores among the rows that lead in some slice of its best tile."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not (queries.num_rows and rows.num_rows):
            return _emit(None, [])
        meet, out = _Meet(queries, rows, m), []
        best = meet.bounds.argmax(axis=1) if meet.bounded else np.zeros(len(meet.q), np.int64)
        for t in np.unique(best):
            tile = meet.tiles[t]
            who = np.flatnonzero(best == t)
            for a in range(0, len(who), TILE):
                some = who[a : a + TILE]
                part = [meet.part(some, tile, s) for s in meet.cuts]
                total = sum(part)
                for n, r in enumerate(some.tolist()):
                    lead = np.unique(np.concatenate([_top(p[n : n + 1], k + 1)[0] for p in part]))
                    copies = meet.copies(r, lead + tile.start)
                    scores = np.repeat(_held(total[n][lead]), np.minimum(copies, k))
                    out += [(r, -1, x) for x in sorted(scores.tolist(), reverse=True)[:k]]
        return _emit(meet, out)

    return run


def _sufficient(meet: _Meet, who: np.ndarray, tile: slice, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in one tile: position in ``who``, row, and score of the entries that may reach the cutoffs ``low``."""
    m = len(meet.cuts)
    if not meet.bounded:
        total = sum(meet.part(who, tile, s) for s in meet.cuts)
        n, c = np.indices(total.shape).reshape(2, -1)
        return n, c + tile.start, total.ravel()
    qn, cn = meet.q_norms[who], meet.c_norms[tile]
    total = np.zeros((len(who), tile.stop - tile.start))
    reaches = np.zeros(total.shape, bool)
    for k, s in enumerate(meet.cuts):
        part = meet.part(who, tile, s)
        total += part
        reaches |= part * m >= low[:, None]
        rest = qn[:, k + 1 :] @ cn[:, k + 1 :].T if k + 1 < m else 0.0
        alive = total + rest >= low[:, None]
        later = [np.outer(qn[:, j], cn[:, j]) * m >= low[:, None] for j in range(k + 1, m)]
        alive &= reaches | (np.logical_or.reduce(later) if later else False)
        if k + 1 < m and alive.mean() < FEW:
            n, c = np.nonzero(alive)
            # The few that are left, one by one.
            left = slice(meet.cuts[k + 1].start, meet.cuts[-1].stop)
            return n, c + tile.start, total[n, c] + np.einsum("ij,ij->i", meet.q[who[n]][:, left], meet.c[c + tile.start][:, left])
    n, c = np.nonzero(alive)
    return n, c + tile.start, total[n, c]


def _resolve(k: int, m: int):
    """Phases 2 and 3: the entries that reach the cutoff; at most k of a query."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not (queries.num_rows and rows.num_rows):
            return _emit(None, [])
        meet, found = _Meet(queries, rows, m), {}
        cutoff = [-LONG - 1 if x is None else x for x in queries.column("cutoff").to_pylist()]
        # A cutoff at the end of longs says nothing about scores beyond it.
        low = np.array([-np.inf if x == -LONG - 1 else x for x in cutoff], float)
        for t, tile in enumerate(meet.tiles):
            who = np.flatnonzero(meet.bounds[:, t] >= low) if meet.bounded else np.arange(len(meet.q))
            for a in range(0, len(who), TILE):
                some = who[a : a + TILE]
                n, c, score = _sufficient(meet, some, tile, low[some])
                score = _held(score)
                for x, y, z in zip(some[n].tolist(), c.tolist(), score.tolist(), strict=True):
                    if z >= cutoff[x]:
                        found.setdefault(x, []).append((-int(z), int(meet.ids[y]), y))
                for x in set(some[n].tolist()) & found.keys():
                    # More than k rows, and the query itself, cannot be needed.
                    found[x] = sorted(found[x])[: k + 1]
        out = []
        for x, best in found.items():
            copies = meet.copies(x, np.array([y for *_, y in best], np.int64))
            every = [(x, y, -z) for (z, _, y), times in zip(best, copies.tolist(), strict=True) for _ in range(min(times, k))]
            out += every[:k]
        return _emit(meet, out)

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, slices: int = 4) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each row whose id ``every`` divides."""
    scratch = Scratch(vectors.sparkSession, "topk")
    as_double = F.col("embedding").cast("array<double>")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), as_double.alias("embedding"))
    data = data.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    data = data.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    data = scratch.keep(data.withColumn("vh", F.xxhash64("embedding")).withColumn("dim", F.size("embedding")))
    is_query = F.col("vec_id") % every == 0
    n, n_queries = data.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_rows, n_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "vh"), F.lit(of)).cast("int")
    rows = data.withColumn("c", block(0, n_rows)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    queries = data.where(is_query).withColumn("q", block(1, n_blocks))
    # Both sides come from one table: the cogroup tells them apart by fresh attributes.
    rows = rows.toDF(*rows.columns).select(*[F.col(x).alias(f"r_{x}") for x in rows.columns])
    spread = lambda x: x.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    schema = "query_id long, vh long, vec_id long, score long"

    def meet(left: DataFrame, run) -> DataFrame:
        return left.groupBy("dim", "q", "c").cogroup(rows.groupBy("r_dim", "r_q", "r_c")).applyInArrow(run, schema)

    lists = meet(spread(queries), _gather(k, slices))
    best = W.partitionBy("query_id", "vh").orderBy(F.col("score").desc())
    cutoff = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), "vh", F.col("score").alias("cutoff"))
    cutoff = scratch.keep(cutoff)
    found = meet(spread(queries.join(cutoff, ["vec_id", "vh"], "left")), _resolve(k, slices))
    final = W.partitionBy("query_id", "vh").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    # Equal queries have equal lists.
    again = queries.where("times > 1").select(F.col("vec_id").alias("query_id"), "vh", "times")
    found = found.join(again, ["query_id", "vh"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), i AS (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM v),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM i q JOIN i c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), t AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 10
"""
