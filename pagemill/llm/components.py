"""Connected components of a table of links, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b (longs, a != b).  Returns (node, root): root is the smallest node that can be
    reached, for every node that has a link.

    Each round replaces the links by a forest that is closer to stars: a node links its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest of them.  The
    number of rounds grows with the logarithm of the longest chain; every round is written
    out, in files by the number of links.  Aggregates combine before the shuffle, and the joins are plain shuffles whose hot
    partitions Spark splits."""
    n = links.count()
    edges = stash(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}-0", n)
    turn, sign = 0, None
    while True:
        turn += 1
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"{name}-{turn}-least", 2 * n)
        # Larger neighbours of a node go to the smallest of the node and its neighbours.
        large = edges.join(least, edges["lo"] == least["k"]).select("hi", F.col("m").alias("lo"))
        large = stash(large.filter("hi <> lo").distinct(), f"{name}-{turn}-large", n)
        # Smaller neighbours of a node, and the node, go to the smallest of them.
        least2 = stash(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "k"), f"{name}-{turn}-least2", n)
        small = large.join(least2, large["hi"] == least2["k"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        small = small.unionByName(least2.select(F.col("k").alias("hi"), F.col("m").alias("lo")))
        edges = stash(small.distinct(), f"{name}-{turn}", 2 * n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    star = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
