"""Protocols that compose other splits; they pass operators as functions ``f(df) -> id, partition``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sunder.plans.distance import nearest
from sunder.plans.groups import assign_folds, group_table
from sunder.plans.rank import value_rank
from sunder.plans.scratch import Scratch

Split = Callable[[DataFrame], DataFrame]


def _subset(df: DataFrame, id_col: str, split: DataFrame, *parts: str) -> DataFrame:
    keep = split.where(F.col("partition").isin(*parts)).select(F.col("id").alias(id_col))
    return df.join(keep, id_col, "left_semi")


def group_k_fold(df: DataFrame, id_col: str, key: str, n_splits: int = 5, auto: bool = False) -> DataFrame:
    """``id, fold, group``: whole groups over folds."""
    return assign_folds(df, id_col, F.col(key), n_splits, auto)


def three_way(df: DataFrame, id_col: str, outer: Split, inner: Split) -> DataFrame:
    """``id, partition``: ``outer`` holds out test, ``inner`` splits the rest; its test is valid."""
    first = outer(df)
    second = inner(_subset(df, id_col, first, "train", "valid"))
    valid = second.select("id", F.when(F.col("partition") == "test", "valid").otherwise(F.col("partition")).alias("p"))
    out = first.select("id", "partition").join(valid, "id", "left")
    return out.select("id", F.coalesce("p", "partition").alias("partition"))


def repeated(df: DataFrame, split: Callable[[DataFrame, int], DataFrame], n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """``id, repeat, partition`` with a derived seed for each repeat."""
    out = None
    for k in range(n_repeats):
        one = split(df, seed * 1000 + k).select("id", F.lit(k).alias("repeat"), "partition")
        out = one if out is None else out.unionByName(one)
    return out


def nested_cv(df: DataFrame, id_col: str, n_outer: int, outer: DataFrame, inner: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``id, outer_fold, inner_fold, partition``: inner test is valid, outer test is test."""
    out = None
    for k in range(n_outer):
        rest = df.join(outer.where(F.col("fold") != k).select(F.col("id").alias(id_col)), id_col, "left_semi")
        folds = inner(rest, k).select("id", F.col("fold").alias("inner"))
        every = folds.select("inner").distinct().withColumnRenamed("inner", "inner_fold")
        trained = folds.crossJoin(F.broadcast(every)).select("id", "inner_fold", F.when(F.col("inner") == F.col("inner_fold"), "valid").otherwise("train").alias("partition"))
        tested = outer.where(F.col("fold") == k).select("id").crossJoin(F.broadcast(every)).select("id", "inner_fold", F.lit("test").alias("partition"))
        one = trained.unionByName(tested).withColumn("outer_fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("id", "outer_fold", "inner_fold", "partition")


def external_holdout(df: DataFrame, id_col: str, external: DataFrame, external_id: str) -> DataFrame:
    """``id, origin, partition``: all records train, all external ones test."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.lit("internal").alias("origin"), F.lit("train").alias("partition"))
    return own.unionByName(external.select(F.col(external_id).cast("long").alias("id"), F.lit("external").alias("origin"), F.lit("test").alias("partition")))


def applicability_domain(vectors: DataFrame, split: DataFrame, n_bands: int = 5) -> DataFrame:
    """``id, band``: test records in equal bands of their distance to the nearest train record."""
    part = lambda p: vectors.join(split.where(F.col("partition") == p).select("id"), "id", "left_semi")
    near = Scratch(vectors.sparkSession, "nearest").keep(nearest(part("test"), part("train")))
    n = near.count()
    n_bands = max(1, min(n_bands, n))
    size, longer = divmod(n, n_bands)
    ranked = value_rank(near, F.col("d"), "id")
    pos, edge = F.col("pos"), longer * (size + 1)
    band = F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - edge) / max(size, 1)))
    return ranked.select("id", band.cast("int").alias("band"))


def applicability_splits(vectors: DataFrame, split: DataFrame, n_bands: int = 5) -> DataFrame:
    """``id, band, partition``: a split for each band, whose test records are that band's; train stays, all others are discarded."""
    bands = Scratch(vectors.sparkSession, "bands").keep(applicability_domain(vectors, split, n_bands))
    every = bands.select(F.col("band").alias("of")).distinct()
    # At most n_bands rows.
    rows = split.select("id", "partition").join(bands, "id", "left").crossJoin(F.broadcast(every))
    part = F.when(F.col("partition") == "train", "train").when(F.col("band") == F.col("of"), "test").otherwise("discard")
    return rows.select("id", F.col("of").alias("band"), part.alias("partition"))


def intersection(primary: DataFrame, groups: DataFrame, conflict_policy: str = "discard") -> DataFrame:
    """``id, partition``: train records that share a group with held-out ones are discarded.

    With ``extend_test``, those that share one with test records are tested.
    """
    met = primary.select("id", "partition").join(groups.select("id", "group"), "id")
    held = met.where("partition in ('valid', 'test')").groupBy("group").agg(F.max(F.when(F.col("partition") == "test", 2).otherwise(1)).alias("held"))
    met = met.join(held, "group", "left")
    conflict = (F.col("partition") == "train") & F.col("held").isNotNull()
    moved = F.when(F.lit(conflict_policy == "extend_test") & (F.col("held") == 2), "test").otherwise("discard")
    return met.select("id", F.when(conflict, moved).otherwise(F.col("partition")).alias("partition"))


def labels_of(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """``id, group`` by a key column."""
    rows, groups = group_table(df, id_col, F.col(key))
    return rows.join(groups, rows["key"].eqNullSafe(groups["key"])).select("id", "group")
