"""Connected components of links between rows, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), the component being its smallest node.

    Each round points all of a node's larger neighbours to its smallest, then all its smaller ones, until nothing changes;
    the number of rounds grows with the logarithm of the longest path. Every round is written to the shared folder. Links
    of a node to itself and repeated links change nothing; no links give no rows.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # large star: neighbours above a node, and the node itself, point to the smallest of its neighbourhood. The smallest
        # are written before they are joined, so that Spark can split the rows of a node with very many neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        release(edges, least)
        # small star: neighbours below a node, and the node itself, point to the smallest of them
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct())
        release(large, least)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
