"""Rows as documents of their own, whatever their ids.

An id may be null or stand on several rows.  A row is known by its id and a hash of
its content, and rows equal in both are counted, not kept apart: so nothing is
lost where ids repeat, nothing depends on the order of rows, and equal rows are
combined before the shuffle, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NO_ID = -(1 << 63)  # stands for null in keys, so that joins need no null-safe comparison


def plain(docs: DataFrame, carry: tuple = (), *content: str) -> DataFrame:
    """``doc_id, text``, ``carry`` as a struct, and the row's key ``kid, th``: its id, and a hash of ``content`` (columns of ``docs``) or of its text."""
    text = docs["text"].cast("string")
    extra = [F.struct(*[docs[c] for c in carry]).alias("carry")] if carry else []
    doc_id = docs["doc_id"].cast("long")
    key = [F.coalesce(doc_id, F.lit(NO_ID)).alias("kid"), F.xxhash64(text, *[docs[c] for c in content]).alias("th")]
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), *extra, *key)


def distinct_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """``kid, th``, the ``columns`` of the smallest of the rows with that key, and ``times``: how many they are."""
    one = rows.groupBy("kid", "th").agg(F.min(F.struct(*columns)).alias("row"), F.count("*").alias("times"))
    return one.select("kid", "th", "row.*", "times")
