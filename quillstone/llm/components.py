"""Connected components of a link table, by alternating large-star and small-star rounds.

Both rounds (Kiveris et al., "Connected Components in MapReduce and Beyond") keep the number of
links linear and halve path lengths, so that some ten rounds suffice at any size.  A node's smaller
neighbours are never gathered: a round is an aggregation (which combines before its shuffle) and a
join back on the node, whose skewed keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node with a link.

    ``links`` has two long columns ``a, b``; order, repeats and self links do not matter; rows
    with a null are left out.  An empty table gives an empty result.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    links = durable(tidy(links))
    before = None
    while True:  # every round lessens the sum of the components' labels until nothing changes
        # large star: every neighbour above the node, and the node, link to its smallest neighbour
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = tidy(large.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        # small star: the smaller neighbours of a node link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = durable(tidy(small.unionAll(low.select("a", F.col("m").alias("b")))))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
