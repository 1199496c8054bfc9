"""Connected components of a table of links, by alternating large and small stars.

Each round keeps, for every node, an edge to its least neighbour; the number of rounds grows with the
logarithm of the longest path. A round is joins and combinable minima over the edge table, which is
written to the shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component``: every linked node with the least node it can reach (the least itself too).

    ``links`` has columns ``a, b`` of one type, in any order and repeated at will; null ends are ignored.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while (now := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()) != state:
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                       .union(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", F.col("b").alias("component")).distinct())
