"""Exact global ranks without a single-task window.

Rows are dealt to ordered buckets (a prefix of the hash key, or a range of the
value), bucket counts give each bucket its offset, and row numbers run inside
buckets in parallel.  A value that many rows share is a bucket of its own, cut by
ranges of the id.  Ranks inside strata work alike, a stratum at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

EDGES = 64


def _ranked(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    # At most a few thousand buckets, whatever the data.
    counts = rows.groupBy("_bucket").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_bucket", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return rows.join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_before") + inside - 1).drop("_bucket", "_before")


def _ranked_within(df: DataFrame, part: str, bucket: Column, order: list[Column], name: str, size: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(part, "_bucket").count()
    # A window over the buckets of a stratum, not over its rows.
    own = W.partitionBy(part)
    before = F.coalesce(F.sum("count").over(own.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(part).alias("_part"), F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("count").over(own).alias(size))
    inside = F.row_number().over(W.partitionBy(part, "_bucket").orderBy(*order))
    rows = rows.withColumn("_inside", inside).join(offsets, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_bucket") == F.col("_b")))
    return rows.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_b", "_part", "_before", "_inside")


def hash_rank(df: DataFrame, key: Column, id_col: str, name: str = "pos") -> DataFrame:
    """Position of each row in the order of a hex digest, ties by id."""
    rows = df.withColumn("_key", key)
    return _ranked(rows, F.substring("_key", 1, 3), [F.col("_key"), F.col(id_col)], name).drop("_key")


def hash_rank_within(df: DataFrame, part: str, key: Column, id_col: str, name: str = "pos", size: str = "size") -> DataFrame:
    """Position of each row in its stratum, in the order of a hex digest, ties by id, and the stratum's size."""
    rows = df.withColumn("_key", key)
    return _ranked_within(rows, part, F.substring("_key", 1, 2), [F.col("_key"), F.col(id_col)], name, size).drop("_key")


def value_rank_within(df: DataFrame, part: str, value: str, name: str = "pos", size: str = "size") -> DataFrame:
    """Position of each row in its stratum by a unique numeric value, and the stratum's size."""
    return _ranked_within(df, part, _value_bucket(df, value), [F.col(value)], name, size)


def _edges(rows: DataFrame, value: str) -> list[float]:
    """Cuts of ``value`` into ``EDGES`` about equally filled ranges; a common value is there several times."""
    return rows.agg(F.percentile_approx(value, [k / EDGES for k in range(1, EDGES)], 2000)).first()[0] or []


def _below(edges: list, value: Column) -> Column:
    """How many of the cuts are below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value)) if edges else F.lit(0)


def _value_bucket(rows: DataFrame, value: str) -> Column:
    return _below(sorted(set(_edges(rows, value))), F.col(value))


def value_rank(df: DataFrame, value: Column, id_col: str, name: str = "pos", descending: bool = False) -> DataFrame:
    """Position of each row by a numeric value, ties by ascending id."""
    rows = df.withColumn("_value", (-value if descending else value).cast("double"))
    edges = _edges(rows, "_value")
    common = sorted({e for e in edges if edges.count(e) > 1})
    bucket = 2 * _below(sorted(set(edges)), F.col("_value"))
    if common and isinstance(df.schema[id_col].dataType, NumericType):
        # The common value is the last of its range: it comes after the range's others, by ranges of the id.
        tied = F.col("_value").isin(*[float(e) for e in common])
        ids = sorted(set(_edges(rows.where(tied), id_col)))
        bucket = F.when(tied, F.struct((bucket + 1).alias("v"), _below(ids, F.col(id_col).cast("double")).alias("i"))).otherwise(F.struct(bucket.alias("v"), F.lit(0).alias("i")))
    return _ranked(rows, bucket, [F.col("_value"), F.col(id_col)], name).drop("_value")


def running_shares(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """``value, next`` and each column's running sum as a share of its total.

    ``df`` has one row per distinct value; ``next`` is the next larger one, null at the end.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    rows = rows.withColumn("_bucket", _value_bucket(rows, value))
    per = rows.groupBy("_bucket").agg(F.min(value).alias("_first"), *[F.sum(c).alias(f"_sum_{c}") for c in columns])
    order = W.orderBy("_bucket")
    every, before = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    # At most EDGES rows.
    offsets = per.select(
        "_bucket", F.lead("_first").over(order).alias("_after"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns],
        *[F.sum(f"_sum_{c}").over(every).alias(f"_total_{c}") for c in columns],
    )
    inside = W.partitionBy("_bucket").orderBy(value)
    run = inside.rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: (F.col(f"_before_{c}") + F.sum(c).over(run)) / F.col(f"_total_{c}")
    out = rows.join(F.broadcast(offsets), "_bucket")
    return out.select(value, F.coalesce(F.lead(value).over(inside), "_after").alias("next"), *[share(c).alias(c) for c in columns])
