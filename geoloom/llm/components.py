"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct links (u, v), v < u, is either the centre of links or has just one."""
    ends = edges.selectExpr("u node", "1 up", "0 down").union(edges.selectExpr("v node", "0 up", "1 down"))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up + down > 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): component is the smallest node reachable.

    Large-star and small-star steps alternate until only stars are left; each keeps one row per node and link at most,
    group minima are pre-aggregated before the shuffle, and each round is written to the shared folder. Nothing is
    gathered on the driver but one count a round. Nodes without links are not in the result; null
    ends are dropped; repeated links and loops are harmless.
    """
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().where("a != b").selectExpr("greatest(a,b) u", "least(a,b) v").distinct(), "links")
    while not _stars(edges):
        both = edges.union(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        star = both.join(low, "u").where("v > u").selectExpr("v u", "m v").where("u != v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(low, "u")
        before, edges = edges, stored(star.selectExpr("u", "m v").union(star.where("v != m").selectExpr("v u", "m v")).where("u != v").distinct(), "stars")
        discard(before)
    return edges.selectExpr("u node", "v component").union(edges.selectExpr("v node", "v component").distinct())
