"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate with map-side combine and an equi-join on the node; the join's edge side may be split by
adaptive execution, so a hub with a third of all edges does not land in one task.  Rounds are cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.plans.lineage import cut, drop, shuffled

#: Edges (16 bytes each) in a file of the tables between steps.
ROWS = 200_000


def _stars(edges: DataFrame, large: bool, many: bool = False) -> DataFrame:
    """One star step over edges (u, v) with u > v; ``many``: too many to broadcast them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        found = both.where("v > u").join(shuffled(least) if many else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(shuffled(least) if many else least, "u")
        found = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    found = found.where("u > v")
    return found if large else found.distinct()  # the small step follows a large one and removes its repeats as well


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node once as u at most, and no u as v."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("n"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("k").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    return roles.where("n > 1 or (n = 1 and root = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another; component is the smallest node of its component.

    Null ends and self-loops are ignored; an empty edge table gives an empty result.
    """
    plain = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("p"), F.col(b).isNotNull().alias("q"))
    current = cut(plain.where("p and q and u > v").select("u", "v").distinct(), "cc")
    files = max(1, -(-current.count() // ROWS))  # a step never makes more edges: no need for many small files
    before = None
    for _ in range(max_rounds):
        if _settled(current):
            break
        large = _stars(current, True, files > 1)
        after = cut(_stars(large, False, files > 1).coalesce(files), "cc")
        drop(before)
        drop(current)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
