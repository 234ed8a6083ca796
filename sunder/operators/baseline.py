"""Random, stratified, k-fold, Monte Carlo and predefined splits."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from sunder.errors import ConfigurationError, LabelError, ScalabilityError
from sunder.functions.hashing import hash_key
from sunder.functions.sizes import Sizes, resolve_sizes
from sunder.plans.rank import hash_rank, hash_rank_within, value_rank


def by_position(pos: Column, sizes: Sizes) -> Column:
    """Train first, then valid, then test."""
    return F.when(pos < sizes.train, "train").when(pos < sizes.train + sizes.valid, "valid").when(pos < sizes.total, "test").otherwise("discard")


def _ids(df: DataFrame, id_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *more)


def random_split(df: DataFrame, id_col: str, seed: int = 0, shuffle: bool = True, k: int = 0, **sizes) -> DataFrame:
    """``id, partition`` by a permutation of the records, or by id without ``shuffle``."""
    rows, n = _ids(df, id_col), df.count()
    key = hash_key(seed, "random.permutation", k, "id")
    ranked = hash_rank(rows, key, "id") if shuffle else value_rank(rows, F.col("id"), "id")
    return ranked.select("id", by_position(F.col("pos"), resolve_sizes(n, **sizes)).alias("partition"))


def strata(df: DataFrame, id_col: str, label: str, n_bins: int = 10, binning: str = "class") -> DataFrame:
    """``id, stratum``: the label itself, or its quantile, uniform or k-means bin."""
    rows = _ids(df, id_col, F.col(label).alias("y"))
    if binning == "class":
        return rows.select("id", F.col("y").cast("string").alias("stratum"))
    if rows.where(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).take(1):
        raise LabelError(f"{label}: binned labels are finite")
    if binning == "kmeans":
        data = rows.select("id", array_to_vector(F.array(F.col("y").cast("double"))).alias("features"))
        k = max(2, min(n_bins, rows.select("y").distinct().limit(n_bins).count()))
        return KMeans(k=k, seed=0, maxIter=50).fit(data).transform(data).select("id", F.col("prediction").cast("string").alias("stratum"))
    if binning == "quantile":
        inner = rows.agg(F.percentile("y", F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)]))).first()[0]
    elif binning == "uniform":
        lo, hi = rows.agg(F.min("y"), F.max("y")).first()
        inner = [lo + (hi - lo) * k / n_bins for k in range(1, n_bins)]
    else:
        raise ConfigurationError(f"unknown binning {binning!r}")
    above = sum((F.when(F.col("y") >= float(e), 1).otherwise(0) for e in sorted(set(inner))), F.lit(0))
    return rows.select("id", above.cast("string").alias("stratum"))


def apportioned(size: Column, n: int, sizes: Sizes) -> tuple[Column, Column]:
    """Train and valid counts of a stratum by largest remainders; equal remainders favour train, then valid."""
    targets = (sizes.train, sizes.valid, sizes.test)
    base = [F.floor(size * t / F.lit(n)) for t in targets]
    rest = [size * t - b * n for t, b in zip(targets, base, strict=True)]
    left = size - base[0] - base[1] - base[2]
    order = lambda k: sum(
        ((rest[j] > rest[k]) | ((rest[j] == rest[k]) & F.lit(j < k))).cast("int") for j in range(3) if j != k
    )
    return tuple(base[k] + (order(k) < left).cast("int") for k in (0, 1))


def stratified_random(df: DataFrame, id_col: str, label: str, seed: int = 0, binning: str = "class", n_bins: int = 10, min_per_stratum: int = 2, k: int = 0, **sizes) -> DataFrame:
    """``id, partition``: every stratum split in the same shares; strata that are too small join the largest."""
    rows, n = strata(df, id_col, label, n_bins, binning), df.count()
    counts = rows.groupBy("stratum").agg(F.count("*").alias("c"))
    # Per stratum, not per record: the largest one takes in those below the least size.
    largest = counts.agg(F.max_by("stratum", F.struct("c", F.hash("stratum"))).alias("largest"))
    counts = counts.crossJoin(F.broadcast(largest)).select("stratum", F.when(F.col("c") < min_per_stratum, F.col("largest")).otherwise(F.col("stratum")).alias("s"))
    rows = rows.join(counts, rows["stratum"].eqNullSafe(counts["stratum"])).select("id", "s")
    rows = hash_rank_within(rows, "s", hash_key(seed, "stratified.permutation", k, "id"), "id")
    train, valid = apportioned(F.col("size"), n, resolve_sizes(n, **sizes))
    return rows.select("id", F.when(F.col("pos") < train, "train").when(F.col("pos") < train + valid, "valid").otherwise("test").alias("partition"))


def k_fold(df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 0, shuffle: bool = True, label: str | None = None, allow_large: bool = False) -> DataFrame:
    """``id, fold``: the fold in which a record is tested; ``n_splits=0`` leaves one out."""
    n = df.count()
    if n_splits == 0:
        if n > 10_000 and not allow_large:
            raise ScalabilityError(f"leave-one-out over {n} records")
        n_splits = n
    if not 2 <= n_splits <= n:
        raise ConfigurationError(f"{n_splits} folds of {n} records")
    key = hash_key(seed, "kfold.permutation", 0, "id")
    if label is not None:
        rows = hash_rank_within(strata(df, id_col, label), "stratum", key, "id")
        return rows.select("id", (F.col("pos") % n_splits).cast("int").alias("fold"))
    rows = _ids(df, id_col)
    ranked = hash_rank(rows, key, "id") if shuffle else value_rank(rows, F.col("id"), "id")
    size, longer = divmod(n, n_splits)
    pos, edge = F.col("pos"), longer * (size + 1)
    return ranked.select("id", F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - edge) / size)).cast("int").alias("fold"))


def monte_carlo(df: DataFrame, id_col: str, n_splits: int = 10, seed: int = 0, **sizes) -> DataFrame:
    """``id, repeat, partition``: independent random splits."""
    rows, resolved = _ids(df, id_col), resolve_sizes(df.count(), **sizes)
    # All repeats in one plan: a repeat is a stratum.
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = hash_rank_within(rows, "repeat", hash_key(seed, "montecarlo.permutation", F.col("repeat"), "id"), "id")
    return rows.select("id", "repeat", by_position(F.col("pos"), resolved).alias("partition"))


def predefined(df: DataFrame, id_col: str, assignment: str | None = None, fold_column: str | None = None, fold: int = 0) -> DataFrame:
    """``id, partition`` from a column of partitions (others are discarded) or of folds (``fold`` is tested)."""
    if (assignment is None) == (fold_column is None):
        raise ConfigurationError("give either an assignment or a fold column")
    if assignment is not None:
        part = F.when(F.col(assignment).isin("train", "valid", "test"), F.col(assignment)).otherwise("discard")
    else:
        part = F.when(F.col(fold_column) == fold, "test").when(F.col(fold_column) >= 0, "train").otherwise("discard")
    return _ids(df, id_col, part.alias("partition"))
