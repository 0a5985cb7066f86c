"""Connected components of an edge list by distributed union-find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def star_rounds(edges: DataFrame, rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Edges (u > v) contracted until every u has one v, the smallest node that it reaches; nodes are longs or structs.

    Rounds of large-star and small-star, each a min-aggregate and an equi-join. Aggregates combine before the shuffle and AQE
    splits hubs in the joins. `keep` cuts the lineage of a round. Rounds grow with the logarithm of the longest path; more than `rounds` raise.
    """
    now = keep(edges.where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        stats = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))), F.countDistinct("u")).first())
        if not stats[0] or (stats == seen and stats[0] == stats[2]):
            return now
        seen = stats
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """node, component of the undirected edges (a, b) between longs; a component's smallest node is named too."""
    done = star_rounds(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    labels = done.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
