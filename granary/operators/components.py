"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregate and a join on the node, so a node with very many edges is
pre-aggregated before the shuffle and its join partition can be split by skew handling.
Rounds grow with the logarithm of a component's size, not with its diameter.  The edge
list of each round is written to the shared folder, which keeps plans short and lets a
lost executor cost one round's tasks only.  Rounds end when the edges are stars, which one
aggregate tells; a round that changes nothing is not run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.lineage import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u, grouped by one more key, so that a join on u shuffles both of its sides itself (see ``splittable``)."""
    return edges.groupBy(F.xxhash64("u").alias("h"), "u").agg(F.min("v").alias("m")).select("u", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    of = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of.agg(F.max(F.expr("up > 1 or up = 1 and down = 1"))).first()[0]


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node of the set.

    Null ends, self loops and repeated edges are ignored; a node that only has self loops
    is not returned.
    """
    a, b = F.col(left), F.col(right)
    now = written(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        after = written(small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        forget(now)
        now = after
        if _settled(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
