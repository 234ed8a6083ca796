"""Splits of pairs of entities: cold compound, cold target, cold pair, joint groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sunder.errors import ConfigurationError
from sunder.plans.groups import assign_groups
from sunder.functions.sizes import resolve_sizes


def _axis(df: DataFrame, id_col: str, key: Column, n: int, sizes, mode: str) -> DataFrame:
    """One axis, at the square root of each fraction of the whole."""
    n_test = min(n - 1, max(1, round((sizes.test / n) ** 0.5 * n)))
    if sizes.valid:
        n_valid = max(1, round((sizes.valid / n) ** 0.5 * n))
        return assign_groups(df, id_col, key, mode, check=False, train=n - n_test - n_valid, valid=n_valid, test=n_test)
    return assign_groups(df, id_col, key, mode, check=False, train=n - n_test, valid=0.0, test=n_test)


def assign_pairs(df: DataFrame, id_col: str, a: Column, b: Column, how: str = "both_novel", mode: str = "greedy_desc", **sizes) -> DataFrame:
    """``id, partition``: both axes are split alone; records on which they disagree are discarded."""
    if how not in ("both_novel", "either_novel"):
        raise ConfigurationError(f"unknown mode {how!r}")
    n = df.count()
    resolved = resolve_sizes(n, **sizes)
    x = _axis(df, id_col, a, n, resolved, mode).select("id", F.col("partition").alias("x"))
    y = _axis(df, id_col, b, n, resolved, mode).select("id", F.col("partition").alias("y"))
    same = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise("discard")
    if how == "either_novel":
        some = lambda p: (F.col("x") == p) | (F.col("y") == p)
        same = F.when(some("test"), "test").when(some("valid"), "valid").otherwise(same)
    return x.join(y, "id").select("id", same.alias("partition"))


def labelled_pairs(df: DataFrame, compound: str, target: str, label: str | None = None, min_interactions: int = 1) -> DataFrame:
    """Pairs with a label, whose entities both have enough of them."""
    rows = df if label is None else df.where(F.col(label).isNotNull())
    if min_interactions > 1:
        for c in (compound, target):
            enough = rows.groupBy(c).count().where(F.col("count") >= min_interactions).select(c)
            rows = rows.join(enough, c, "left_semi")
    return rows


def cold_entity(df: DataFrame, id_col: str, entity: str, mode: str = "greedy_desc", **sizes) -> DataFrame:
    """``id, partition, group``: no entity of the axis is on both sides."""
    return assign_groups(df, id_col, F.col(entity), mode, **sizes)
