"""Splits by a property or label: extrapolation cuts, distinct levels, matched distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.errors import ConfigurationError, ConstraintError
from sunder.functions.hashing import hash_key
from sunder.functions.sizes import resolve_sizes
from sunder.plans.rank import hash_rank, hash_rank_within, value_rank
from sunder.plans.scratch import Scratch

DIRECTIONS = ("high_test", "low_test", "extremes_test", "middle_test")


def _tested(rows: DataFrame, n: int, n_test: int, direction: str, tie_policy: str, seed: int, purpose: str) -> DataFrame:
    """Rows with their position by value and whether they are tested."""
    if direction not in DIRECTIONS:
        raise ConfigurationError(f"unknown direction {direction!r}")
    if tie_policy not in ("by_index", "keep_together", "random"):
        raise ConfigurationError(f"unknown tie policy {tie_policy!r}")
    rows = value_rank(rows, F.col("v"), "id")
    pos = F.col("pos")
    low = {"low_test": n_test, "extremes_test": n_test // 2}.get(direction, 0)
    high = {"high_test": n_test, "extremes_test": n_test - n_test // 2}.get(direction, 0)
    if direction == "middle_test":
        start = (n - n_test) // 2
        return rows.withColumn("tested", (pos >= start) & (pos < start + n_test))
    if tie_policy == "by_index":
        return rows.withColumn("tested", (pos < low) | (pos >= n - high))
    rows = Scratch(rows.sparkSession, "cut").keep(rows)
    at = {r.pos: r.v for r in rows.where(pos.isin(low - 1, n - high)).collect()}
    lo, hi = at.get(low - 1) if low else None, at.get(n - high) if high else None
    tested = F.lit(False)
    for bound, side, count in ((lo, "low", low), (hi, "high", high)):
        if bound is None:
            continue
        beyond = F.col("v") < bound if side == "low" else F.col("v") > bound
        if tie_policy == "keep_together":
            tested = tested | beyond | (F.col("v") == bound)
        else:
            name = f"tie_{side}"
            ties = hash_rank(rows.where(F.col("v") == bound).select("id"), hash_key(seed, purpose, 0, "id"), "id", name)
            need = count - rows.where(beyond).count()
            rows = rows.join(ties, "id", "left")
            tested = tested | beyond | F.coalesce(F.col(name) < need, F.lit(False))
    return rows.withColumn("tested", tested)


def _nearest_valid(rows: DataFrame, n_valid: int) -> DataFrame:
    """Of the rows that are neither tested nor discarded, those nearest to the tested range are valid."""
    final = F.when(F.col("tested"), "test").when(F.col("gone"), "discard").otherwise("train")
    if not n_valid:
        return rows.select("id", final.alias("partition"))
    rows = Scratch(rows.sparkSession, "valid").keep(rows)
    lo, hi = rows.where("tested").agg(F.min("v"), F.max("v")).first()
    near = value_rank(rows.where("not tested and not gone"), F.least(F.abs(F.col("v") - lo), F.abs(F.col("v") - hi)), "id", "near")
    rows = rows.join(near.select("id", "near"), "id", "left")
    return rows.select("id", F.when(F.col("near") < n_valid, "valid").otherwise(final).alias("partition"))


def property_split(df: DataFrame, id_col: str, value: str, direction: str = "high_test", tie_policy: str = "by_index", seed: int = 0, **sizes) -> DataFrame:
    """``id, partition``: the extreme (or middle) values are tested."""
    n = df.count()
    resolved = resolve_sizes(n, **sizes)
    rows = df.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("v"))
    rows = _tested(rows, n, resolved.test, direction, tie_policy, seed, "property.tie").withColumn("gone", F.lit(False))
    return _nearest_valid(rows, resolved.valid)


def label_extrapolation(df: DataFrame, id_col: str, label: str, direction: str = "high_test", buffer: float | int = 0.0, tie_policy: str = "keep_together", seed: int = 0, **sizes) -> DataFrame:
    """As by a property, with equal labels kept together and a buffer beside the tested range discarded.

    A float buffer is a distance, an int one a number of nearest records.
    """
    n = df.count()
    resolved = resolve_sizes(n, **sizes)
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("v"))
    rows = _tested(rows, n, resolved.test, direction, tie_policy, seed, "label.tie")
    rows = Scratch(df.sparkSession, "label").keep(rows)
    gone = F.lit(False)
    if buffer:
        lo, hi = rows.where("tested").agg(F.min("v"), F.max("v")).first()
        if isinstance(buffer, float):
            gone = ~F.col("tested") & ((F.abs(F.col("v") - lo) < buffer) | (F.abs(F.col("v") - hi) < buffer))
        else:
            near = value_rank(rows.where("not tested"), F.least(F.abs(F.col("v") - lo), F.abs(F.col("v") - hi)), "id", "near")
            rows = rows.join(near.select("id", "near"), "id", "left")
            gone = F.coalesce(F.col("near") < buffer, F.lit(False))
    rows = rows.withColumn("gone", gone).drop("near")
    if buffer and rows.where("gone").count() > 0.5 * n:
        raise ConstraintError(f"the buffer removes more than half of {n} records")
    return _nearest_valid(rows, resolved.valid)


def distinct_label(df: DataFrame, id_col: str, label: str, resolution: float | None = None, seed: int = 0, n_valid: int = 0) -> DataFrame:
    """``id, partition``: one record of each label level trains, the others are held out."""
    level = F.col(label) if resolution is None else F.floor(F.col(label) / resolution)
    rows = df.select(F.col(id_col).alias("id"), level.alias("level"))
    # One record of a level, by an aggregate that combines before the shuffle.
    pick = rows.groupBy("level").agg(F.min(F.struct(hash_key(seed, "distinct_label.pick", 0, "id").alias("k"), "id")).alias("first"))
    rows = rows.join(pick.select(F.col("first.id").alias("id"), F.lit(True).alias("picked")), "id", "left").select("id", F.coalesce("picked", F.lit(False)).alias("picked"))
    if not n_valid:
        return rows.select("id", F.when(F.col("picked"), "train").otherwise("test").alias("partition"))
    held = hash_rank(rows.where("not picked").select("id"), hash_key(seed, "distinct_label.valid", 0, "id"), "id")
    rows = rows.join(held, "id", "left")
    return rows.select("id", F.when(F.col("picked"), "train").when(F.col("pos") < n_valid, "valid").otherwise("test").alias("partition"))


def stratified_distribution(df: DataFrame, id_col: str, label: str, n_bins: int = 20, seed: int = 0, method: str = "histogram", n_trials: int = 50, **sizes) -> DataFrame:
    """``id, partition`` whose labels are spread alike.

    ``histogram``: every quantile bin of the label gives its share, rounded half to even, to test and valid.
    ``moments`` and ``ks``: of ``n_trials`` random splits, the one whose sides differ least in mean and deviation
    (in deviations of all labels), or in the Kolmogorov-Smirnov distance of test to train; equal ones go to the first.
    """
    n = df.count()
    resolved = resolve_sizes(n, **sizes)
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("v"))
    if method == "histogram":
        inner = rows.agg(F.percentile("v", F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)]))).first()[0]
        above = sum((F.when(F.col("v") > float(e), 1).otherwise(0) for e in sorted(set(inner))), F.lit(0))
        rows = hash_rank_within(rows.withColumn("bin", above), "bin", hash_key(seed, "stratdist.permutation", 0, "id"), "id")
        test = F.bround(F.col("size") * (resolved.test / n))
        valid = F.bround(F.col("size") * (resolved.valid / n))
        return rows.select("id", F.when(F.col("pos") < test, "test").when(F.col("pos") < test + valid, "valid").otherwise("train").alias("partition"))
    if method not in ("moments", "ks"):
        raise ConfigurationError(f"unknown method {method!r}")
    trials = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
    trials = hash_rank_within(trials, "trial", hash_key(seed, "stratdist.trial", F.col("trial"), "id"), "id")
    part = F.when(F.col("pos") < resolved.train, "train").when(F.col("pos") < resolved.train + resolved.valid, "valid").otherwise("test")
    trials = Scratch(df.sparkSession, "trials").keep(trials.select("id", "v", "trial", part.alias("partition")))
    if method == "moments":
        scale = rows.agg(F.stddev_pop("v")).first()[0] or 1.0
        side = lambda f, p: f(F.when(F.col("partition") == p, F.col("v")))
        gap = lambda f: F.abs(side(f, "test") - side(f, "train")) / scale
        loss = trials.groupBy("trial").agg((gap(F.avg) + gap(F.stddev_pop)).alias("loss"))
    else:
        # Counts of a trial's sides at each distinct label; running sums inside ranges of the label.
        per = trials.groupBy("trial", "v").agg(*[F.sum((F.col("partition") == p).cast("long")).alias(p) for p in ("train", "test")])
        edges = rows.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 2000)).first()[0] or []
        per = per.withColumn("b", F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e < F.col("v"))) if edges else F.lit(0))
        before = W.partitionBy("trial").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        base = per.groupBy("trial", "b").agg(F.sum("train").alias("x"), F.sum("test").alias("y"))
        base = base.select("trial", "b", F.coalesce(F.sum("x").over(before), F.lit(0)).alias("x"), F.coalesce(F.sum("y").over(before), F.lit(0)).alias("y"))
        run = W.partitionBy("trial", "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        per = per.withColumn("own_x", F.sum("train").over(run)).withColumn("own_y", F.sum("test").over(run)).join(base, ["trial", "b"])
        off = F.abs((F.col("x") + F.col("own_x")) / resolved.train - (F.col("y") + F.col("own_y")) / resolved.test)
        loss = per.groupBy("trial").agg(F.max(off).alias("loss"))
    best = loss.agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "trial")).alias("m")).first().m.trial
    return trials.where(F.col("trial") == best).select("id", "partition")
