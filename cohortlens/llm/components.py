"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b) but the roots: root is the smallest node that node can reach.

    Each round hangs every node's neighbours under the smallest of them, first the larger neighbours, then the
    smaller ones; the rounds grow with the logarithm of the longest path. Every round is written, so a lost
    executor costs one round. Nothing is collected but two sums that tell when the edges stopped changing.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        # an edge to the smallest neighbour stays for nodes without larger neighbours
        large = cut(large.unionByName(low.filter(F.col("_u") > F.col("_m")).select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct())
        low = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        small = large.join(low, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        edges = cut(small.unionByName(low.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now
