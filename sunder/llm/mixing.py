"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S should be taken T/S times on
average.  The whole part is taken outright; the fraction is rounded by pivots
(Deville and Tille 1998): two documents with fractions p and q exchange mass,
weighted by their sizes so that the words taken stay the same, until one of
them is 0 or 1.  Which way is drawn such that either fraction keeps its mean.

A group of documents leaves at most one undecided fraction.  Those residuals
are paired again one level up, in a reduction tree whose groups follow from
the ids' hashes: (source, bucket), (source, bucket / FAN), ... (source).  The last
residual of a source is drawn alone, so a source's words differ from its target
by less than one document's words.  Draws are hashes of the seed and the ids, so
reruns agree whatever the partitioning.

Rows equal in id, source and text (and ``carry``) are drawn as one: their number times
the ratio is their share, and the copies that it comes to are dealt evenly among them.

Defined cases: a null text has size 0 and is taken 0 words; null sources are
one source, the last in order; rows with the same id or without one are documents of
their own, told apart by a 64-bit hash of their text; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from sunder.llm.rows import NO_ID, distinct_rows, plain
from sunder.plans.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
FAN = 8
GROUP = 4096


def _draw(seed: int, a: int, b: int, level: int) -> float:
    digest = hashlib.blake2b(f"{seed}:{level}:{a}:{b}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot(ids, sizes, shares, seed: int, level: int) -> tuple[np.ndarray, int]:
    """Decide all but at most one row: the final shares (0.0 or 1.0) and the undecided row, or -1."""
    p = [float(x) for x in shares]
    held = -1
    for k in range(len(p)):
        if sizes[k] == 0 or p[k] <= 1e-12 or p[k] >= 1 - 1e-12:
            p[k] = 0.0 if sizes[k] == 0 else float(round(p[k]))
            continue
        if held < 0:
            held = k
            continue
        i, ratio = held, sizes[held] / sizes[k]
        up = min(1 - p[i], p[k] / ratio)  # i gains, k loses
        down = min(p[i], (1 - p[k]) / ratio)  # i loses, k gains
        if _draw(seed, ids[i], ids[k], level) * (up + down) < down:
            step = up
            i_done, value = up == 1 - p[i], 1.0
        else:
            step = -down
            i_done, value = down == p[i], 0.0
        other = p[k] - step * ratio
        if i_done:
            p[i] = value
            p[k] = min(1.0, max(0.0, other))
            held = k
        else:
            p[k] = 1.0 - value
            p[i] = min(1.0, max(0.0, p[i] + step))
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held] = float(round(p[held]))
            held = -1
    return np.array(p), held


def _round_group(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "kid", "th"], kind="stable", ignore_index=True)
        ids, sizes = pdf["h"].tolist(), pdf["size"].tolist()
        p, held = pivot(ids, sizes, pdf["share"], seed, level)
        if last and held >= 0:
            p[held] = float(_draw(seed, ids[held], -1, level) < p[held])
            held = -1
        pdf["share"] = p
        pdf["done"] = np.arange(len(pdf)) != held
        return pdf

    return run


def source_targets(sizes: DataFrame, total_percent: int = 150, limit: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, none above ``limit`` times the source's size.

    Sources that hit their limit are those with the smallest size to weight.
    With sources in that order, one pass of running sums finds how many they are.
    Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int")))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(every) * (total_percent / 100.0))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit)
    )
    level = (F.col("total") - F.col("full")) / F.col("weight_left")
    per = per.withColumn("level", level).withColumn("free", level * F.col("weight") <= limit * F.col("source_size"))
    per = per.withColumn("common", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("free"), F.col("common") * F.col("weight")).otherwise((limit * F.col("source_size")).cast("double"))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _shares(rows: DataFrame, seed: int, total_percent: int, limit: int) -> DataFrame:
    """``kid, th, source, size, times, source_size, target, copies``: what the mix takes of equal rows in all."""
    scratch = Scratch(rows.sparkSession, "mix")
    sizes = scratch.keep(rows.groupBy("kid", "th", "source", "size").agg(F.count("*").alias("times")))
    words = sizes.select("source", (F.col("size") * F.col("times")).alias("size"))
    targets = scratch.keep(source_targets(words, total_percent, limit))
    units = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("times")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(ratio)).withColumn("share", ratio - F.floor(ratio))
    n, buckets = sizes.count(), 1
    while buckets * GROUP < n:
        buckets *= FAN
    units = units.withColumn("h", F.xxhash64(F.lit(seed), "kid", "th")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    state = ["kid", "th", "source", "size", "times", "source_size", "target", "whole", "share", "h", "bucket"]
    open_rows, decided, level = units.select(*state), [], 0
    while True:
        last = buckets == 1
        frame = open_rows.withColumn("done", F.lit(False))
        out = scratch.keep(frame.groupBy("source", "bucket").applyInPandas(_round_group(seed, level, last), frame.schema))
        decided.append(out.where("done"))
        if last:
            break
        open_rows = out.where("not done").drop("done").withColumn("bucket", F.floor(F.col("bucket") / FAN))
        buckets //= FAN
        level += 1
    final = decided[0]
    for more in decided[1:]:
        final = final.unionByName(more)
    scratch.drop(sizes, targets)
    return final.withColumn("copies", (F.col("whole") + F.col("share")).cast("long"))


def _sized(docs: DataFrame, carry: tuple) -> DataFrame:
    rows = plain(docs.withColumn("source", F.col("source").cast("string")), ("source", *carry), "source", *carry)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return rows.withColumn("source", F.col("carry.source")).withColumn("size", size)


def mix_sources(docs: DataFrame, seed: int = 8, total_percent: int = 150, limit: int = 2) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``docs(doc_id, text, source)``."""
    units = _shares(_sized(docs, ()), seed, total_percent, limit)
    rows = units.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    copies = F.floor(F.col("copies") / F.col("times")) + (F.col("nth") < F.col("copies") % F.col("times")).cast("long")
    rows = rows.withColumn("copies", copies)
    return rows.select(F.nullif("kid", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, carry: tuple = (), seed: int = 8, total_percent: int = 150, limit: int = 2) -> DataFrame:
    """The mix itself: ``doc_id, text`` and a struct ``carry`` of the source and ``carry``, a row for each copy."""
    rows = _sized(docs, carry)
    taken = _shares(rows.select("kid", "th", "source", "size"), seed, total_percent, limit).where("copies > 0").select("kid", "th", "copies")
    one = distinct_rows(rows, "doc_id", "text", "carry").join(taken, ["kid", "th"])
    return one.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "text", "carry")
