"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.  ``links``: a, b (longs).

    Large-star and small-star steps in turn: the first hangs a node's larger neighbours on the smallest
    one known, the second does so with the smaller ones, until all that is left are stars.  Each round is
    checkpointed.  Nodes without links, and links of a node with itself, are left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint()
    for _ in range(most_rounds):
        best = edges.groupBy("hi").agg(F.min("lo").alias("best"))
        # large-star: hi hangs on the smallest neighbour of lo
        up = edges.join(best.select(F.col("hi").alias("lo"), "best"), "lo", "left").select("hi", F.coalesce("best", "lo").alias("lo")).distinct().checkpoint()
        # small-star: hi's other smaller neighbours hang on the smallest of them
        best = up.groupBy("hi").agg(F.min("lo").alias("best"))
        over = up.join(best, "hi").where("lo <> best").select(F.col("lo").alias("hi"), F.col("best").alias("lo"))
        edges = best.select("hi", F.col("best").alias("lo")).unionByName(over).distinct().checkpoint()
        low = edges.select(F.col("lo").alias("hi")).distinct()
        several = edges.groupBy("hi").count().where("count > 1").select("hi")
        if edges.join(low, "hi", "left_semi").select("hi").unionByName(several).isEmpty():
            roots = edges.select(F.col("lo").alias("node")).distinct()
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
