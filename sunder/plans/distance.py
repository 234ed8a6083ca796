"""Distance access paths: token joins for sets, block joins for vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.plans.rank import value_rank
from sunder.plans.scratch import Scratch

BLOCK = 2048


def token_sets(df: DataFrame, id_col: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """``id, u`` of each record with a token, and one row ``u, n, t`` for each distinct set, named by its smallest id.

    Sets are sorted 64-bit hashes of tokens.  Both are written once, and texts are split once.
    """
    scratch = Scratch(df.sparkSession, "tokens")
    rows = df.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(F.transform(F.col(tokens), lambda x: F.xxhash64(x)))).alias("t")).where(F.size("t") > 0)
    # A set is known by two hashes of it; equal ones combine before the shuffle.
    rows = scratch.keep(rows.withColumn("k1", F.xxhash64("t")).withColumn("k2", F.xxhash64(F.lit(1), "t")))
    sets = scratch.keep(rows.groupBy("k1", "k2").agg(F.min("id").alias("u")))
    members = scratch.keep(rows.select("id", "k1", "k2").join(sets, ["k1", "k2"]).select("id", "u"))
    own = rows.select(F.col("id").alias("u"), F.size("t").alias("n"), "t").join(sets.select("u"), "u", "left_semi")
    own = scratch.keep(own)
    scratch.drop(rows)
    return members, own


def set_edges(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, inter, na, nb`` with a < b of distinct sets whose Jaccard similarity is at least num / den, exactly.

    Two such sets share one of the rarest ``n - ceil(n * num / den) + 1`` tokens of
    either, and the first one that they share leaves enough tokens after it in both; only such pairs are compared.
    """
    one = sets.select(F.col("u").alias("id"), "n", F.explode("t").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    # A token of one set meets nobody: it counts as a place in the prefix only.
    ranked = one.join(often, "token", "left").withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("often", F.lit(1)), "token")))
    prefix = ranked.where((F.col("k") <= F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1) & F.col("often").isNotNull()).select("id", "n", "k", "token")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), "token")
    near = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), "token").join(other, "token")
    most = 1 + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    near = near.where((F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (most * (num + den) >= (F.col("na") + F.col("nb")) * num))
    near = near.select("a", "b", "na", "nb").distinct()
    met = near.join(sets.select(F.col("u").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("u").alias("b"), F.col("t").alias("tb")), "b")
    met = met.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("inter"), "na", "nb")
    return met.where(F.col("inter") * den >= num * (F.col("na") + F.col("nb") - F.col("inter")))


def token_edges(df: DataFrame, id_col: str, tokens: str, num: int, den: int) -> DataFrame:
    """``a, b, inter, na, nb`` with a < b and Jaccard similarity of at least num / den, exactly.

    Distinct sets are compared; all pairs of their records follow, which is what was asked
    for.  ``token_links`` has no more rows than records and links.  Records without a token have no edge.
    """
    members, sets = token_sets(df, id_col, tokens)
    found = set_edges(sets, num, den)
    equal = sets.select(F.col("u").alias("a"), F.col("u").alias("b"), F.col("n").alias("inter"), F.col("n").alias("na"), F.col("n").alias("nb"))
    of = lambda c: members.select(F.col("u").alias(c), F.col("id").alias(f"{c}_id"))
    # Records of one set, where there are several.
    several = members.groupBy("u").count().where("count > 1").select(F.col("u").alias("a"))
    pairs = found.unionByName(equal.join(several, "a", "left_semi")).join(of("a"), "a").join(of("b"), "b").where("a < b or a_id < b_id")
    swap = F.col("a_id") > F.col("b_id")
    return pairs.select(
        F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "inter", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")
    )


def token_links(df: DataFrame, id_col: str, tokens: str, num: int, den: int) -> DataFrame:
    """``a, b`` with the components of ``token_edges``: pairs of distinct sets, and each record with its set's first one."""
    members, sets = token_sets(df, id_col, tokens)
    copies = members.where("id <> u").select(F.col("u").alias("a"), F.col("id").alias("b"))
    return set_edges(sets, num, den).select("a", "b").unionByName(copies)


def scaled_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """``id, v``: vectors as integers, so that both engines compute the same distances."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _block_join(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, block_pairs: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Run ``kernel(ids, vectors, ids, vectors, same)`` over pairs of blocks, and give the columns that it returns.

    ``left`` and ``right`` are ``id, v`` and, with ``block_pairs(p, q)``, their ``block``; without it, blocks are dealt by hash and all pairs of them meet.
    """
    if block_pairs is None:
        n_left, n_right = max(1, -(-left.count() // size)), max(1, -(-right.count() // size))
        block = lambda n: F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(n)).cast("int")
        x = left.select("id", "v", block(n_left).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("q"))
        y = right.select(F.col("id").alias("id2"), F.col("v").alias("v2"), block(n_right).alias("q2")).withColumn("p2", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    else:
        x = left.join(block_pairs, F.col("block") == F.col("p")).select("id", "v", "p", "q")
        y = right.join(block_pairs, F.col("block") == F.col("q")).select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("p").alias("p2"), F.col("q").alias("q2"))

    paired = block_pairs is not None

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in schema.split(", ")]
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64() if " long" in x else pa.float64()) for c, x in zip(names, schema.split(", "), strict=True)})
        same = paired and a.column("p")[0] == a.column("q")[0]
        out = kernel(a.column("id").to_numpy(), _matrix(a.column("v")), b.column("id2").to_numpy(), _matrix(b.column("v2")), same)
        return pa.table(dict(zip(names, map(pa.array, out), strict=True)))

    return x.groupBy("p", "q").cogroup(y.groupBy("p2", "q2")).applyInArrow(run, schema)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def vector_edges(vectors: DataFrame, cutoff: float) -> DataFrame:
    """``a, b, d`` with a < b and squared Euclidean distance of at most ``cutoff``.

    Blocks are ranges of the distance to one record.  By the triangle inequality only
    blocks whose ranges are at most the cutoff apart can hold a pair, so that others never meet.
    """
    scratch = Scratch(vectors.sparkSession, "edges")
    first = vectors.agg(F.min_by("v", "id").alias("v")).first()
    if first is None or first.v is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, d double")
    origin = F.array(*[F.lit(float(x)) for x in first.v])
    away = F.sqrt(F.aggregate(F.zip_with("v", origin, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = value_rank(vectors.select("id", "v", away.alias("away")), F.col("away"), "id")
    rows = scratch.keep(rows.select("id", "v", "away", F.floor(F.col("pos") / BLOCK).cast("int").alias("block")))
    ranges = scratch.keep(rows.groupBy("block").agg(F.min("away").alias("lo"), F.max("away").alias("hi")))
    later = ranges.select(F.col("block").alias("q"), F.col("lo").alias("lo_q"))
    # A little more than the cutoff, for the rounding of roots.
    apart = float(np.sqrt(max(cutoff, 0.0))) * (1 + 1e-9) + 1e-6
    pairs = scratch.keep(ranges.select(F.col("block").alias("p"), "hi").join(later, (F.col("p") <= F.col("q")) & (F.col("lo_q") <= F.col("hi") + apart)).select("p", "q"))

    def kernel(a, x, b, y, same):
        d = _squared(x, y)
        i, j = np.nonzero(d <= cutoff)
        u, v, d = a[i], b[j], d[i, j]
        one = u < v if same else u != v
        return np.minimum(u, v)[one], np.maximum(u, v)[one], d[one]

    return _block_join(rows, rows, kernel, "a long, b long, d double", pairs)


def near_groups(vectors: DataFrame, grouped: DataFrame, cutoff: float) -> DataFrame:
    """``id, group``: the groups of ``grouped(id, v, group)`` that have another record within ``cutoff`` (squared distance) of a record.

    Each pair of blocks gives its groups, not its pairs; a record and group may come several times.
    """

    def kernel(a, x, b, y, same):
        group, at = np.unique(y[:, -1], return_inverse=True)
        order = np.argsort(at, kind="stable")
        b, y, start = b[order], y[order, :-1], np.searchsorted(at[order], np.arange(len(group)))
        rows, found = [], []
        for k in range(0, len(a), 512):
            d = _squared(x[k : k + 512], y) <= cutoff
            d &= a[k : k + 512, None] != b[None, :]
            i, j = np.nonzero(np.logical_or.reduceat(d, start, axis=1))
            rows.append(a[k + i])
            found.append(group[j].astype(np.int64))
        return np.concatenate(rows), np.concatenate(found)

    # A record's group travels as one more component.
    right = grouped.select("id", F.concat("v", F.array(F.col("group").cast("double"))).alias("v"))
    return _block_join(vectors.select("id", "v"), right, kernel, "id long, group long", size=4 * BLOCK)


def nearest(query: DataFrame, reference: DataFrame) -> DataFrame:
    """``id, nn, d``: each query's nearest reference, the smallest id among equals."""

    def kernel(a, x, b, y, same):
        order = np.argsort(b, kind="stable")
        b, d = b[order], _squared(x, y[order])
        at = d.argmin(axis=1)
        return a, b[at], d[np.arange(len(a)), at]

    each = _block_join(query.select("id", "v"), reference.select("id", "v"), kernel, "id long, nn long, d double")
    return each.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("m")).select("id", "m.nn", "m.d")


def distance_sums(vectors: DataFrame) -> DataFrame:
    """``id, total``: the sum of distances to all records, over pairs of blocks.

    Both orders of a pair are computed and every sum runs in one order, so that equal vectors have equal sums.
    """

    def kernel(a, x, b, y, same):
        d = np.sqrt(np.maximum(_squared(x, y[np.argsort(b, kind="stable")]), 0))
        return a, d.sum(axis=1)

    rows = vectors.select("id", "v")
    each = _block_join(rows, rows, kernel, "id long, total double")
    parts = each.groupBy("id").agg(F.array_sort(F.collect_list("total")).alias("t"))  # one number per block
    return parts.select("id", F.aggregate("t", F.lit(0.0), lambda s, x: s + x).alias("total"))


def squared_distance_sums(vectors: DataFrame) -> DataFrame:
    """``id, total``: the sum of squared distances to all records, in closed form from two sums."""
    dims = vectors.select(F.size("v").alias("k")).first()
    if dims is None:
        return vectors.select("id", F.lit(0.0).alias("total"))
    sums = vectors.agg(F.count("*").alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("s2"), *[F.sum(F.col("v")[k]).alias(f"s{k}_") for k in range(dims.k)]).first()
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    centre = F.array(*[F.lit(float(sums[f"s{k}_"])) for k in range(dims.k)])
    dot = F.aggregate(F.zip_with("v", centre, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", (own * sums.n + F.lit(float(sums.s2)) - 2 * dot).alias("total"))
