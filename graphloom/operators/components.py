"""Connected components of an undirected graph, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.skew import hot_join
from graphloom.sources.tables import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: the greater neighbours of u go to u's least neighbour; small: u and its lesser ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_rows"))
    moved = hot_join(both, least, "u", "_rows", F.col("v"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns u, v); a component is named after its least node.

    Each round is a large and a small star (Kiveris et al., 2014): the number of rounds grows with the
    logarithm of the component's diameter, no neighbourhood is ever gathered in one row, and hubs are
    split by ``hot_join``. Rounds are cut by a checkpoint, so a lost executor costs no more than its part.
    Self-loops and repeated edges don't matter; null ends are dropped; no edges give no rows.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seal = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    last = seal(now)
    for _ in range(max_rounds):
        if not last["n"]:
            break
        now = cut(_star(_star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        new = seal(now)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
