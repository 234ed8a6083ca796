"""Featurizers as columns, and pairwise metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shingle_bits(text: Column, size: int = 3, n_bits: int = 2048) -> Column:
    """Sorted on-bits of the hashed word shingles of a text; a null text has none."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    grams = F.when(F.size(w) > 0, F.transform(at, lambda k: F.array_join(F.slice(w, k, size), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(n_bits)).cast("int"))))


def pack(bits: Column, n_bits: int = 2048) -> Column:
    """On-bits as words of 64 bits."""
    words = F.sequence(F.lit(0), F.lit(n_bits // 64 - 1))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    return F.transform(words, lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(one(b))))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def _counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    bits = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + F.bit_count(v))
    return bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))), bits(a), bits(b)


def tanimoto(a: Column, b: Column) -> Column:
    """Distance of packed bit sets; of two empty ones it is 0."""
    both, x, y = _counts(a, b)
    return F.when(x + y - both == 0, 0.0).otherwise(1 - both / (x + y - both))


def dice(a: Column, b: Column) -> Column:
    both, x, y = _counts(a, b)
    return F.when(x + y == 0, 0.0).otherwise(1 - 2 * both / (x + y))


def tanimoto_count(a: Column, b: Column) -> Column:
    """Distance of count vectors: 1 - sum of minima / sum of maxima."""
    low = _sum(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")))
    high = _sum(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double")))
    return F.when(high == 0, 0.0).otherwise(1 - low / high)


def cosine(a: Column, b: Column) -> Column:
    """Distance; 0 for two zero vectors, 1 if one is zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    x, y = (F.sqrt(_sum(F.transform(v, lambda z: z * z))) for v in (a, b))
    return F.when((x == 0) & (y == 0), 0.0).when((x == 0) | (y == 0), 1.0).otherwise(1 - dot / (x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


METRICS = {"tanimoto": tanimoto, "dice": dice, "tanimoto_count": tanimoto_count, "cosine": cosine, "euclidean": euclidean, "manhattan": manhattan}
BOUNDED = frozenset(("tanimoto", "dice", "tanimoto_count", "cosine"))
