"""Splits that need one record alone, so that they run on streams as on tables.

These are an extension: nothing here needs state, watermarks or a total count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sunder.functions.hashing import uniform


def bernoulli(df: DataFrame, id_col: str, test: float = 0.2, valid: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds ``partition``: each record by its own hash, so sizes are met on average only."""
    u = uniform(seed, "stream", 0, id_col)
    return df.withColumn("partition", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def by_date(df: DataFrame, date: str, cut_date: str, embargo_days: int = 0) -> DataFrame:
    """Adds ``partition``: up to the cut trains, after the embargo tests."""
    d, cut = F.to_date(date), F.lit(cut_date).cast("date")
    return df.withColumn("partition", F.when(d <= cut, "train").when(d < F.date_add(cut, embargo_days), "discard").otherwise("test"))
