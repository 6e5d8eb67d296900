"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_IDS, cut, forget

#: Edges of a node from which on its smallest neighbour is sent to all tasks instead of its edges to one.
HUB = 1000
#: Edges that are no burden even for one task; with fewer, hubs get no care.
FEW = 1_000_000


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One star step.  ``edges`` (u, v) are distinct and u > v; ``n`` of them, of which a few need no care for hubs."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("u", "m"))
    if n < FEW:
        joined = both.join(least.select("u", "m"), "u")
    else:
        least = cut(least)
        joined = _with_least(both, least)
    if small:
        # every neighbour, all smaller, and u itself hang under the smallest
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (u, v) with u's least neighbour m; edges of hubs stay where they are, if hubs are counted to be few."""
    hubs = least.where(F.col("degree") >= HUB).select("u", "m")
    if not 0 < hubs.count() <= BROADCAST_IDS:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    rest = edges.join(hubs, "u", "left_anti").join(least.where(F.col("degree") < HUB).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has columns u and v, in any order and repetition.  Each round ends in files of the shared folder.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before, n = None, now.count()
    for _ in range(rounds):
        last, now = now, cut(_star(_star(now, False, n), True, n))
        forget(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    under = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return under.unionByName(under.select(F.col("component").alias("node"), "component").distinct())
