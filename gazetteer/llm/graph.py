"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetteer.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v); the root is the component's smallest node.

    Nodes are of any type with an order.  Each round hooks neighbours to the
    smallest node around; it ends when the edges form stars, that is, when every
    node has one parent and no parent has a parent, which is looked up and not
    estimated.  Rounds grow with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        children = edges.groupBy("u").agg(F.count(F.lit(1)).alias("_parents"))
        twice = children.where("_parents > 1").select("u")
        chained = edges.select(F.col("v").alias("_v")).distinct().join(edges.select("u"), F.col("_v") == F.col("u"), "left_semi")
        if twice.unionByName(chained.select(F.col("_v").alias("u"))).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(least, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = cut_lineage(small.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
