"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.storage import cut, forget


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to the least of its neighbourhood."""
    sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(sym).select("u", F.least("m", "u").alias("m"))
    return sym.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    joined = down.join(_least(down), "u")
    lesser = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = _least(down).select("u", F.col("m").alias("v"))
    return lesser.union(own).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a node that has none of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("of")).union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("of").alias("of")).where("own > 1 or own = 1 and of = 1")
    return loose.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for each node of an edge table (u, v), where a component is named by its least node.

    Both steps keep connectivity and are repeated until each node has one edge, to the least of its component, which takes a
    number of rounds that grows with the logarithm of the largest component. Each round is written to the shared folder, so a
    lost executor costs one round at most, and deleted once the next one is. A hub's edges are joined with one row, which
    adaptive execution can split. Self-loops and repeated edges have no effect, rows with a null are left out, and no edges
    give no rows. Not to have settled after ``most_rounds`` (a path of some 2 to the power of 50 nodes would need as many)
    raises RuntimeError.
    """
    now = cut(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds = 0
    while not _settled(now):
        if rounds == most_rounds:
            raise RuntimeError(f"not settled after {most_rounds} rounds")
        before, now, rounds = now, cut(small_star(large_star(now))), rounds + 1
        forget(before)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
