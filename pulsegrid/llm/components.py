"""Connected components of a graph given by its links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (long, any direction).  Returns node, root: every node of a link with the smallest node it reaches.

    A round replaces the links of each node by links to the smallest node known to it: first for its larger neighbours
    (large star), then for the smaller ones (small star).  Both need a grouped minimum, which is combined before the
    shuffle, and a join back, whose hot keys Spark splits; no neighbour list is ever collected.  Rounds end when the
    links no longer change; their number grows with the logarithm of the longest path.  Self-links and repeated links do
    no harm.  No links give no rows.
    """
    edges = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # edges hold u > v: the larger neighbours of v are its u.
        large = edges.join(smallest, F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(lowest, F.col("u") == F.col("c"))
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
