"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (u, v); the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller
    neighbours likewise, until nothing changes: rounds grow with the logarithm of the longest
    chain. A node's smallest neighbour is an aggregate combined before it is moved, so a node
    with very many links is no task of its own. Every round is written, lineage stays short.
    """
    edges = common.settle(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = common.settle(small.where("u != v").distinct())
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
