"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import by_merge, materialise

#: A node with more edges than this, or than a share of all edges that leaves at most ``HEAVY_NODES`` such nodes, is heavy.
HEAVY, HEAVY_NODES = 100_000, 100_000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of its u.

    Minima are taken map-side first.  Heavy nodes, of which there are few by
    the bound, travel to the edges as a broadcast; so the edges of a star's
    centre stay where they are, and only those of other nodes meet by their node.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    limit = max(HEAVY, -(-total // HEAVY_NODES))
    if total <= limit:  # no node can be heavy
        return edges.join(by_merge(least.select("u", "m")), "u")
    least = materialise(least, "least")
    heavy = least.where(F.col("n") > limit).select("u", "m")
    light = least.where(F.col("n") <= limit).select("u", "m")
    if heavy.isEmpty():
        return edges.join(by_merge(light), "u")
    known = edges.join(F.broadcast(heavy.withColumnRenamed("m", "heavy")), "u", "left")
    return known.where("heavy is not null").select("u", "v", F.col("heavy").alias("m")).unionByName(known.where("heavy is null").select("u", "v").join(by_merge(light), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): the least node that each can reach.

    Alternates large-star and small-star steps, which halve depths; every step
    is a written table of at most twice the edges.  Loops and repeated edges
    are allowed; an empty table has no components.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()
        large = materialise(large, "edges") if total > HEAVY else large
        small = _with_least(large, total)
        up = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(up.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        crooked = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low > 0 and high > 0")
        if crooked.isEmpty():  # only stars are left
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def grouped(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``vertices`` with ``comp``: singletons are their own component."""
    found = materialise(components(edges), "components").withColumnRenamed("node", key)
    return vertices.join(by_merge(found), key, "left").withColumn("comp", F.coalesce("comp", key))
