"""The contract of a split, and its serialised form."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.errors import InputError, SizeToleranceWarning, SmallPartitionWarning

PARTITIONS = ("train", "valid", "test", "discard")
SCHEMA = "sunder/split/1"


def assert_split(split: DataFrame, n: int, size_tolerance: float | None = None, wanted: dict[str, int] | None = None) -> dict[str, int]:
    """Check that ids are unique and complete and partitions known, groups whole; returns the sizes.

    One pass of aggregates; warns of small partitions and, if asked, of sizes that are far off.
    """
    count = [F.count(F.when(F.col("partition") == p, 1)).alias(p) for p in PARTITIONS]
    row = split.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), *count).first()
    if row.n != n or row.ids != n or sum(row[p] for p in PARTITIONS) != n:
        raise InputError(f"{row.n} rows with {row.ids} ids for {n} records")
    if "group" in split.columns:
        kept = split.where("partition <> 'discard' and `group` is not null")
        if kept.groupBy("group").agg(F.count_distinct("partition").alias("k")).where("k > 1").take(1):
            raise InputError("a group is on more than one side")
    sizes = {p: row[p] for p in PARTITIONS}
    for p in ("train", "test"):
        if sizes[p] < 10 or sizes[p] < 0.01 * n:
            warnings.warn(SmallPartitionWarning(f"{p} has {sizes[p]} of {n} records", partition=p, size=sizes[p]), stacklevel=2)
    for p, k in (wanted or {}).items():
        if size_tolerance is not None and abs(sizes[p] - k) > size_tolerance * n:
            warnings.warn(SizeToleranceWarning(f"{p} has {sizes[p]} records, {k} were asked for", partition=p), stacklevel=2)
    return sizes


BLOCK = 1 << 20


def runs(split: DataFrame) -> DataFrame:
    """``partition, first, last``: runs of consecutive ids of a partition (gaps and islands), inside blocks of ``BLOCK`` ids."""
    w = W.partitionBy("partition", "block").orderBy("id")
    rows = split.select("partition", "id", F.floor(F.col("id") / BLOCK).alias("block"))
    rows = rows.select("partition", "block", "id", (F.col("id") - F.row_number().over(w)).alias("island"))
    return rows.groupBy("partition", "block", "island").agg(F.min("id").alias("first"), F.max("id").alias("last")).select("partition", "first", "last")


def to_json(split: DataFrame, operator: str, params: dict) -> str:
    """A split as JSON: sorted keys; runs of three or more ids as ``[first, last]``.  For splits that fit the driver."""
    out: dict = {"schema": SCHEMA, "operator": operator, "params": params, **{p: [] for p in PARTITIONS}}
    whole: list[list] = []
    for r in runs(split).orderBy("partition", "first").toLocalIterator():
        # A run goes on in the next block.
        if whole and whole[-1][0] == r.partition and whole[-1][2] + 1 == r.first:
            whole[-1][2] = r.last
        else:
            whole.append([r.partition, r.first, r.last])
    for part, first, last in whole:
        out[part] += [[first, last]] if last - first >= 2 else list(range(first, last + 1))
    return json.dumps(out, sort_keys=True, separators=(",", ":"))


def from_json(spark, text: str) -> DataFrame:
    """``id, partition`` of a serialised split."""
    data = json.loads(text)
    if data.get("schema") != SCHEMA:
        raise InputError(f"no split: schema {data.get('schema')!r}")
    rows = [(p, *(x if isinstance(x, list) else (x, x))) for p in PARTITIONS for x in data[p]]
    table = spark.createDataFrame(rows, "partition string, first long, last long")
    return table.select(F.explode(F.sequence("first", "last")).alias("id"), "partition")
