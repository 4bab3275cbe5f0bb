"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node (combined before its shuffle) and an equi-join; no node's
neighbours meet in one place, and nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _pointed(arcs: DataFrame) -> DataFrame:
    """arcs (u, v) with m: the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _pointed(down)
    return m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is its component's least node."""
    now = work.table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most):
        now = work.table(_small_star(_large_star(now)), "star")
        n, check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (n, check) == mark:
            break
        mark = (n, check)
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
