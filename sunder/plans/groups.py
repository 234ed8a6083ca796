"""Groups: dense labels and the assignment of whole groups to partitions or folds."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sunder.errors import ConfigurationError, ConstraintError, DegenerateGroupingError, LargeGroupWarning, ScalabilityError
from sunder.functions.hashing import hash_key
from sunder.functions.sizes import Sizes, resolve_sizes
from sunder.plans.rank import value_rank, value_rank_within

MAX_GROUPS = 20_000_000


def group_table(df: DataFrame, id_col: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their key, and per key its size, smallest id and dense label in order of first appearance."""
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return rows, value_rank(groups, F.col("first"), "first", "group")


def check_groups(groups: DataFrame, n: int, what: str) -> None:
    """Raise if one group holds over 95 % of the records, warn from 60 %."""
    largest = groups.agg(F.max("size")).first()[0] or 0
    if largest > 0.95 * n:
        raise DegenerateGroupingError(f"{what}: the largest group holds {largest} of {n} records")
    if largest > 0.6 * n:
        warnings.warn(LargeGroupWarning(f"{what}: the largest group holds {largest} of {n} records", largest=largest), stacklevel=2)


def _fold(sizes: Sizes, mode: str):
    """Sequential by definition: each group's place depends on those before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "first"] if mode == "random" else ["size", "first"], ascending=[mode == "random", True], kind="stable", ignore_index=True)
        every = [("train", sizes.train), ("valid", sizes.valid), ("test", sizes.test)]
        names, capacity = zip(*[x for x in every if x[1] > 0], strict=True)
        filled, out = [0] * len(names), []
        for m in pdf["size"].tolist():
            if mode == "balanced":
                at = min(range(len(names)), key=lambda b: (max(0, filled[b] + m - capacity[b]) / max(1, capacity[b]), b))
            else:
                at = min(range(len(names)), key=lambda b: (filled[b] - capacity[b], b))
            filled[at] += m
            out.append(names[at])
        pdf["place"] = out
        return pdf[["key", "group", "place"]]

    return run


def segments(rooms: list[float], size: int, m: int) -> tuple[list[tuple[int, int, list[int]]], list[float]]:
    """Where ``m`` groups of one size go, each to the place with most room, the first of equals; and the rooms after them.

    A segment (start, stop, cycle) sends the groups from start to stop to the places of the cycle in turn.
    """
    rooms, out, at = list(rooms), [], 0
    while at < m:
        order = sorted(range(len(rooms)), key=lambda b: (-rooms[b], b))
        top = rooms[order[0]]
        # Places within one size of the roomiest take turns until another one has as much room.
        cycle = [b for b in order if rooms[b] > top - size]
        outside = [rooms[b] for b in order if rooms[b] <= top - size]
        turns = (m - at) // len(cycle)
        if outside:
            turns = min(turns, int((top - size - outside[0]) // size))
        if turns == 0:
            cycle, turns = cycle[:1], 1
        for b in cycle:
            rooms[b] -= turns * size
        out.append((at, at + turns * len(cycle), cycle))
        at += turns * len(cycle)
    return out, rooms


def _placed_by_size(groups: DataFrame, rooms: list[float], names: list, place_type: str) -> DataFrame:
    """Largest first, equal ones by their first record: a fold over distinct sizes, of which n records have at most the root of 2 n."""
    counts = {r["size"]: r["count"] for r in groups.groupBy("size").count().collect()}
    rows = []
    for size in sorted(counts, reverse=True):
        parts, rooms = segments(rooms, size, counts[size])
        rows += [(size, start, stop, [names[b] for b in cycle]) for start, stop, cycle in parts]
    spark = groups.sparkSession
    plan = spark.createDataFrame(rows, f"of_size long, start long, stop long, cycle array<{place_type}>")
    plan = plan.groupBy("of_size").agg(F.collect_list(F.struct("start", "stop", "cycle")).alias("parts"))
    ranked = value_rank_within(groups, "size", "first", "nth", "n_of_size").join(plan, F.col("size") == F.col("of_size"))
    part = F.filter("parts", lambda x: (x.start <= F.col("nth")) & (F.col("nth") < x.stop))[0]
    ranked = ranked.withColumn("part", part)
    place = F.expr("part.cycle[CAST((nth - part.start) % size(part.cycle) AS INT)]")
    return ranked.select("key", "group", place.alias("place"))


def _placed(groups: DataFrame, sizes: Sizes, mode: str, n: int, seed: int) -> DataFrame:
    if mode == "greedy_desc":
        every = [(name, k) for name, k in (("train", sizes.train), ("valid", sizes.valid), ("test", sizes.test)) if k > 0]
        return _placed_by_size(groups, [k for _, k in every], [name for name, _ in every], "string")
    if groups.count() > MAX_GROUPS:
        raise ScalabilityError(f"more than {MAX_GROUPS} groups")
    key_type = groups.schema["key"].dataType.simpleString()
    table = groups.withColumn("order", hash_key(seed, "group.assign", 0, "first"))
    # One row per group, not per record.
    return table.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fold(sizes, mode), f"key {key_type}, group long, place string")


def assign_groups(df: DataFrame, id_col: str, key: Column, mode: str = "greedy_desc", seed: int = 0, check: bool = True, discarded: Column | None = None, **sizes) -> DataFrame:
    """``id, partition, group``: whole groups, largest first, to the partition with most room.

    Records for which ``discarded`` holds are set aside first: they have no group, labels and sizes are those of the others.
    """
    if mode not in ("greedy_desc", "balanced", "random"):
        raise ConfigurationError(f"unknown group assignment {mode!r}")
    if discarded is not None:
        gone = F.coalesce(discarded, F.lit(False))
        kept = assign_groups(df.where(~gone), id_col, key, mode, seed, check, **sizes)
        return kept.unionByName(df.where(gone).select(F.col(id_col).alias("id"), F.lit("discard").alias("partition"), F.lit(None).cast("long").alias("group")))
    rows, groups = group_table(df, id_col, key)
    n = df.count()
    if check:
        check_groups(groups, n, "group assignment")
    placed = _placed(groups, resolve_sizes(n, **sizes), mode, n, seed)
    return rows.join(placed, rows["key"].eqNullSafe(placed["key"])).select("id", F.col("place").alias("partition"), "group")


def assign_folds(df: DataFrame, id_col: str, key: Column, n_splits: int = 5, auto: bool = False) -> DataFrame:
    """``id, fold, group``: whole groups over folds of near-equal size; ``auto``: one fold per group."""
    rows, groups = group_table(df, id_col, key)
    n_groups = groups.count()
    if auto:
        # Each group is a fold of its own, the largest first.
        ranked = value_rank_within(groups, "size", "first", "nth", "n_of_size")
        larger = W.orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
        # One row per distinct size.
        before = groups.groupBy("size").count().select("size", F.coalesce(F.sum("count").over(larger), F.lit(0)).alias("before"))
        placed = ranked.join(before, "size").select("key", "group", (F.col("before") + F.col("nth")).cast("int").alias("place"))
        return rows.join(placed, rows["key"].eqNullSafe(placed["key"])).select("id", F.col("place").alias("fold"), "group")
    if n_groups < n_splits:
        raise ConstraintError(f"{n_groups} groups for {n_splits} folds")
    placed = _placed_by_size(groups, [df.count() / n_splits] * n_splits, list(range(n_splits)), "int")
    return rows.join(placed, rows["key"].eqNullSafe(placed["key"])).select("id", F.col("place").alias("fold"), "group")


def pair_sizes(n: int, fractions: tuple[float, float, float]) -> Sizes:
    """Counts on one of two axes: the square root of each fraction, normalised to the axis."""
    valid, test = (round(n * f**0.5) for f in fractions[1:])
    return Sizes(n - valid - test, valid, test)
