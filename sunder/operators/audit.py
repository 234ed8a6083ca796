"""Leakage audit of a split: nearest neighbours, duplicates, shared groups, shifts; and preprocessing of replicates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sunder.errors import EmptyPartitionError, LabelError
from sunder.functions.hashing import hash_key
from sunder.plans.distance import nearest
from sunder.plans.rank import hash_rank, running_shares
from sunder.plans.scratch import Scratch

QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)

# Thresholds of similarity that a report counts, and cut-offs of its flags.
ABOVE = (0.4, 0.6, 0.8, 0.9, 0.99)
MAX_SIMILARITY, MEDIAN_SIMILARITY = 0.99, 0.6
LOW_AUC, HIGH_AUC = 0.55, 0.90
LABEL_P, SMALL_TEST, LARGE_D = 0.01, 30, 0.5


def nn_profile(vectors: DataFrame, split: DataFrame, query: str = "test", reference: str = "train") -> DataFrame:
    """One row: quantiles and mean of the squared distance of ``query`` records to their nearest ``reference`` record."""
    part = lambda p: vectors.join(split.where(F.col("partition") == p).select("id"), "id", "left_semi")
    d = nearest(part(query), part(reference))
    q = F.percentile("d", F.array(*[F.lit(x) for x in QUANTILES]))
    out = d.agg(q.alias("q"), F.avg("d").alias("mean"), F.count("*").alias("n"))
    return out.select(*[F.col("q")[k].alias(f"q{round(100 * x):03d}") for k, x in enumerate(QUANTILES)], "mean", "n")


def duplicates_across(df: DataFrame, id_col: str, key: str, split: DataFrame) -> DataFrame:
    """``test_id, train_id``: held-out records whose key a train record has, with the first such record."""
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("key")).join(split.select("id", "partition"), "id")
    first = rows.where("partition = 'train' and key is not null").groupBy("key").agg(F.min("id").alias("train_id"))
    return rows.where("partition = 'test'").join(first, "key").select(F.col("id").alias("test_id"), "train_id")


def shared_groups(df: DataFrame, id_col: str, key: str, split: DataFrame) -> DataFrame:
    """One row: distinct keys on each side and on both."""
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("key")).join(split.select("id", "partition"), "id")
    side = lambda p: F.max((F.col("partition") == p).cast("int")).alias(p)
    per = rows.where("key is not null").groupBy("key").agg(side("train"), side("test"))
    return per.agg(F.sum("train").alias("n_train"), F.sum("test").alias("n_test"), F.sum(F.col("train") * F.col("test")).alias("n_shared"))


def label_shift(df: DataFrame, id_col: str, label: str, split: DataFrame) -> DataFrame:
    """``partition, n, mean, std, skew`` of the label (population moments)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).join(split, "id").where("y is not null")
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.skewness("y").alias("skew"))


def property_shift(df: DataFrame, id_col: str, column: str, split: DataFrame) -> DataFrame:
    """One row: Cohen's d of test against train with the pooled sample deviation, 0 if that is 0."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("double").alias("y")).join(split, "id")
    of = lambda f, p: f(F.when(F.col("partition") == p, F.col("y")))
    s = rows.agg(*[of(f, p).alias(f"{k}_{p}") for p in ("train", "test") for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n_train") - 1) * F.col("v_train") + (F.col("n_test") - 1) * F.col("v_test")) / (F.col("n_train") + F.col("n_test") - 2))
    return s.select(F.when(pooled > 0, (F.col("m_test") - F.col("m_train")) / pooled).otherwise(0.0).alias("cohens_d"))


def ks_statistic(df: DataFrame, id_col: str, column: str, split: DataFrame) -> DataFrame:
    """One row: the largest gap between the distributions of train and test, from counts per distinct value."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("double").alias("y")).where("y is not null").join(split, "id")
    side = lambda p: F.sum((F.col("partition") == p).cast("long")).alias(p)
    per = Scratch(df.sparkSession, "ks").keep(rows.groupBy("y").agg(side("train"), side("test")))
    return running_shares(per, "y", "train", "test").agg(F.max(F.abs(F.col("train") - F.col("test"))).alias("ks"))


def ks_p_value(ks: float, n: int, m: int) -> float:
    """The probability of a gap as large by chance: Kolmogorov's limit distribution."""
    x = ks * math.sqrt(n * m / (n + m))
    if x < 0.2:  # the series is 1 there to ten digits
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def histogram(values: DataFrame, column: str = "d", bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``bin, n`` of equal bins, empty ones included; the last is closed, values outside are not counted."""
    x = F.col(column)
    at = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1))
    counts = values.where((x >= low) & (x <= high)).groupBy(at.cast("long").alias("bin")).count()
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def cosine_nearest(vectors: DataFrame, split: DataFrame) -> DataFrame:
    """``id, nn, d``: cosine distance of each test record to its nearest train record.

    Of unit vectors it is half the squared euclidean distance; a zero vector stays one.
    """
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("id", "v", size.alias("size")).select("id", F.transform("v", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(F.lit(0.0))).alias("v"))
    part = lambda p: unit.join(split.where(F.col("partition") == p).select("id"), "id", "left_semi")
    return nearest(part("test"), part("train")).select("id", "nn", F.greatest(F.col("d") / 2, F.lit(0.0)).alias("d"))


def flags(report: dict) -> list[str]:
    """The warnings that a report gives cause for, in a fixed order; what it lacks raises none."""
    auc, high = report.get("adversarial_auc"), lambda k: report.get(k) or 0
    found = [
        ("EXACT_DUPLICATES_ACROSS_PARTITIONS", high("n_duplicates") > 0),
        ("HIGH_MAX_SIMILARITY", high("max_similarity") > MAX_SIMILARITY),
        ("MEDIAN_NN_ABOVE_0.6", high("median_similarity") > MEDIAN_SIMILARITY),
        ("SHARED_SCAFFOLDS", high("shared_scaffold") > 0),
        ("SHARED_SOURCES", high("shared_source") > 0),
        ("LOW_ADVERSARIAL_AUC", auc is not None and auc < LOW_AUC),
        ("HIGH_ADVERSARIAL_AUC", auc is not None and auc > HIGH_AUC),
        ("LABEL_SHIFT", report.get("label_ks_p", 1.0) < LABEL_P),
        ("SMALL_TEST", report["n_test"] < SMALL_TEST),
    ]
    shifts = sorted(k for k in report if k.startswith("shift_"))
    found += [(f"PROPERTY_SHIFT_{k.removeprefix('shift_')}", abs(report[k]) > LARGE_D) for k in shifts if report[k] is not None]
    return [name for name, raised in found if raised]


def audit_split(
    vectors: DataFrame, split: DataFrame, records: DataFrame | None = None, key: str | None = None, scaffold: str | None = None,
    source: str | None = None, label: str | None = None, properties: tuple[str, ...] = (), auc: Callable | None = None,
) -> dict:
    """The whole report of a split, its flags included, from one-row aggregates.

    ``records`` has ``id`` and the columns named; ``auc(vectors, split)`` is an
    adversarial validation.  What is not named is not in the report.
    """
    split = Scratch(split.sparkSession, "audit").keep(split.select("id", "partition"))
    out = {f"n_{r.partition}": r["count"] for r in split.groupBy("partition").count().collect()}
    if not out.get("n_train") or not out.get("n_test"):
        raise EmptyPartitionError("an audit takes train and test records")
    near = 1 - F.col("d")
    above = [F.avg((near > x).cast("double")).alias(f"above_{x}") for x in ABOVE]
    seen = cosine_nearest(vectors, split).agg(F.max(near).alias("max_similarity"), F.percentile(near, 0.5).alias("median_similarity"), F.avg(near).alias("mean_similarity"), *above)
    out |= seen.first().asDict()
    if key is not None:
        out["n_duplicates"] = duplicates_across(records, "id", key, split).count()
    for name, column in (("scaffold", scaffold), ("source", source)):
        if column is not None:
            out[f"shared_{name}"] = shared_groups(records, "id", column, split).first().n_shared or 0
    if label is not None:
        for r in label_shift(records, "id", label, split).collect():
            out |= {f"label_{k}_{r.partition}": r[k] for k in ("mean", "std", "skew")}
            out[f"label_n_{r.partition}"] = r.n
        if out.get("label_n_train") and out.get("label_n_test"):
            out["label_ks"] = ks_statistic(records, "id", label, split).first().ks
            out["label_ks_p"] = ks_p_value(out["label_ks"], out["label_n_train"], out["label_n_test"])
    for column in properties:
        out[f"shift_{column}"] = property_shift(records, "id", column, split).first().cohens_d
    if auc is not None:
        out["adversarial_auc"] = auc(vectors, split)
    out["flags"] = flags(out)
    return out


def scrambled(labelled: DataFrame, seed: int, k: int) -> DataFrame:
    """``id, y`` with the labels of ``labelled(id, y)`` dealt anew: position in one hash order to position in another."""
    ids = hash_rank(labelled.select("id"), hash_key(seed, "scramble.to", k, "id"), "id")
    labels = hash_rank(labelled.select("id", "y"), hash_key(seed, "scramble.from", k, "id"), "id").select("pos", "y")
    return ids.join(labels, "pos").select("id", "y")


def scramble_control(labelled: DataFrame, split: DataFrame, fit_score: Callable[[DataFrame, DataFrame], float], n_repeats: int = 20, seed: int = 0) -> dict:
    """Whether a model's score on test beats those of models fitted to scrambled train labels.

    ``labelled`` has ``id, v, y``; ``fit_score(train, test)`` fits on one and scores
    on the other, larger being better.  It passes if it beats at least 95 % of them.
    """
    rows = Scratch(labelled.sparkSession, "scramble").keep(labelled.where("y is not null").join(split.select("id", "partition"), "id"))
    train, test = (rows.where(F.col("partition") == p).select("id", "v", "y") for p in ("train", "test"))
    if not train.take(1) or not test.take(1):
        raise LabelError("no labelled record in train or in test")
    observed = fit_score(train, test)
    scores = [fit_score(train.select("id", "v").join(scrambled(train, seed, k), "id"), test) for k in range(n_repeats)]
    beats = sum(observed > s for s in scores) / n_repeats
    return {"observed_score": observed, "scrambled_scores": scores, "p_value": 1 - beats, "passes": beats >= 0.95}


def find_duplicates(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """``key, first, n`` of keys that several records have."""
    out = df.groupBy(F.col(key).alias("key")).agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    return out.where("n > 1 and key is not null")


def aggregate_replicates(df: DataFrame, id_col: str, key: str, value: str, how: str = "median", max_spread: float | None = None) -> DataFrame:
    """``key, first, value, n``: one row per key; keys whose values spread too far are dropped."""
    calc = {
        "median": F.median("v"), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "first": F.min_by("v", "id"),
        "drop_conflicting": F.min("v"),
    }[how]
    rows = df.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    out = rows.groupBy("key").agg(F.min("id").alias("first"), calc.alias("value"), F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("spread"))
    limit = 0.0 if how == "drop_conflicting" else max_spread
    return (out if limit is None else out.where(F.col("spread") <= limit)).drop("spread")
