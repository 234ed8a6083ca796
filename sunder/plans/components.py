"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each
step is an aggregate and an equi-join, so a hub with millions of neighbours is
never gathered in one place: its minimum is found by a map-side combined
aggregate, which is written before the hub's edges are joined to it, so that
Spark can split those edges over tasks.  Rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sunder.plans.scratch import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One step: link a node's larger (or smaller) neighbours to its minimum."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = scratch.keep(out.where("u <> v").distinct())
    scratch.drop(low, edges)
    return out


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is its smallest node.

    Null ends and self loops are ignored.  An empty edge table gives an empty result.
    """
    now = scratch.keep(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    for _ in range(max_rounds):
        now = _star(_star(now, True, scratch), False, scratch)
        # Stars are left when no node has two edges down and no root has one.
        n, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and not now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
