"""Connected components of an edge list, distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import remove, store


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """edges(a long, b long) -> node, root: the smallest node that each node is linked with, over all linked nodes.

    Each round writes the edges to the shared folder, so the plan stays short. Only minima per node are shuffled
    together, so a node with any number of edges is no more work for one task than its rows. Loops and repeated edges
    do no harm; no edges give no rows. Each round hangs nodes on smaller ones and none ever on a larger one, so the edges
    come to rest; that takes about the square of the logarithm of the nodes at most. The result's table is added to scratch.
    """
    spark, path = edges.sparkSession, None
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, path = store(edges, "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after, new = store(small, "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        remove(spark, path)
        current, path = after, new
        if state == before:
            break
        before = state
    found = current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out, kept = store(found, "roots")
    remove(spark, path)
    if scratch is not None:
        scratch.append(kept)
    return out
