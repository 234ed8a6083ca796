"""Readers: Parquet or CSV tables, and small deterministic fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV, JSON or ORC table, by the path's ending."""
    kind = next((k for k in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).format(kind).load(path)


def two_clusters(spark: SparkSession, n: int = 80, dim: int = 4, gap: float = 10.0) -> DataFrame:
    """``id, v, group``: two far clusters of equal size."""
    noise = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0)
    rows = spark.range(n).withColumn("group", F.col("id") % 2)
    return rows.select("id", F.array(*[noise(k) + F.col("group") * gap for k in range(dim)]).alias("v"), "group")


def dated_series(spark: SparkSession, n: int = 100, groups: int = 5) -> DataFrame:
    """``id, date, group``: 180 days between groups, up to 60 within."""
    rows = spark.range(n).withColumn("group", F.col("id") % groups)
    days = (F.col("group") * 180 + F.pmod(F.xxhash64("id"), F.lit(60))).cast("int")
    return rows.select("id", F.date_add(F.lit("2015-01-01").cast("date"), days).alias("date"), "group")


def interactions(spark: SparkSession, compounds: int = 40, targets: int = 10, density: float = 0.25) -> DataFrame:
    """``id, compound, target``: a random bipartite graph."""
    rows = spark.range(compounds * targets)
    keep = F.pmod(F.xxhash64(F.lit("edge"), "id"), F.lit(1000)) < density * 1000
    return rows.where(keep).select("id", F.floor(F.col("id") / targets).alias("compound"), (F.col("id") % targets).alias("target"))


def label_extremes(spark: SparkSession, n: int = 100, ties: int = 60, at: float = 5.0) -> DataFrame:
    """``id, y``: two modes, and many ties at one value."""
    return spark.range(n).select("id", F.when(F.col("id") < ties, at).otherwise(F.when(F.col("id") % 2 == 0, F.col("id") / 100).otherwise(10 + F.col("id") / 100)).alias("y"))
