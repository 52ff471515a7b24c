"""Connected components of links between 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """The smallest id that each linked id reaches: (node, root). Links are (a, b), in any direction, repeats allowed.

    Every round points each node at its smallest neighbour, shortens these chains by two jumps and replaces the ends
    of each link by what they point to. Links within one tree vanish, and every node that isn't a local minimum is
    merged, so the rounds are logarithmic. Only the question whether links are left comes to the driver.
    """
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    found = staged(found, "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
        step = staged(near.select("node", F.least("node", "p").alias("p")), "step")
        for _ in range(2):
            ahead = step.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            step = staged(step.join(ahead, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "step")
        to = step.select(F.col("node").alias("root"), "p")
        found = staged(found.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        ends = edges
        for side in ("a", "b"):
            to = step.select(F.col("node").alias(side), F.col("p").alias(f"p{side}"))
            ends = ends.join(to, side, "left")
        ends = ends.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        edges = staged(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return found
