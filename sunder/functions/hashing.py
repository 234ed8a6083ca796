"""Randomness as a hash order: a seeded draw depends on the record id alone.

``md5(seed:purpose:k:id)`` gives every record a position that neither the
partitioning nor the row order can change, and that SQL can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(seed: int, purpose: str, k, id_col: str) -> Column:
    """Hex digest that orders records for draw ``k`` of ``purpose``; ``k`` may be a column."""
    step = k.cast("string") if isinstance(k, Column) else F.lit(str(k))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), step, F.col(id_col).cast("string")))


def hash_key_sql(seed: int, purpose: str, k, id_col: str) -> str:
    """The same expression as DuckDB text; ``k`` is a number or an SQL expression."""
    return f"md5(concat_ws(':', '{seed}', '{purpose}', CAST({k} AS VARCHAR), CAST({id_col} AS VARCHAR)))"


def uniform(seed: int, purpose: str, k, id_col: str) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of the key."""
    return F.conv(F.substring(hash_key(seed, purpose, k, id_col), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
