"""[SO8] Components of a relation: parents that only become smaller, hooked to smaller grandparents and shortened in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.cuts import Cuts


def components(edges: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """node, component (the smallest node that is reached) for every node of edges (a, b); direction doesn't matter.

    Each node holds a parent and a grandparent. In a round it learns the least grandparent of its neighbours; its parent, and the node
    itself, are hooked to that, and paths are halved. Trees meet at their roots, so the rounds grow with the logarithm of the
    longest path, whatever its order of numbers. Each round's table is written to the shared folder, and the one before deleted; the session is
    left as it is. Null ends and loops are nodes at most. Joins are merges: files of numbers are far smaller than their rows, so that Spark would send
    whole tables to the driver and broadcast them, again in each round."""
    cuts = cuts or Cuts(edges.sparkSession, "components")
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cuts.write("edges", pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    start = nodes.join(least.hint("merge"), nodes.node == least.a, "left").select("node", F.least("node", F.coalesce("b", "node")).alias("parent"))
    now = _grand(cuts.write("parents-0", start), cuts, 0)
    rounds = 0
    while True:
        rounds += 1
        seen = both.join(now.select(F.col("node").alias("b"), "grand").hint("merge"), "b").groupBy("a").agg(F.min("grand").alias("least"))
        near = now.join(seen.withColumnRenamed("a", "node").hint("merge"), "node", "left").withColumn("least", F.least("grand", F.coalesce("least", "grand")))
        hooks = near.groupBy(F.col("parent").alias("node")).agg(F.min("least").alias("hook"))
        told = near.join(hooks.hint("merge"), "node", "left").select("node", F.least("parent", "least", F.coalesce("hook", "parent")).alias("parent"), F.col("grand").alias("was"))
        after = _grand(cuts.write(f"parents-{rounds}", told), cuts, rounds)
        changed = not after.where("grand <> was or parent <> grand").isEmpty()
        cuts.drop(f"parents-{rounds - 1}", f"grand-{rounds - 1}")
        now = after.select("node", "parent", "grand")
        if not changed:
            return now.select("node", F.col("grand").alias("component"))


def _grand(parents: DataFrame, cuts: Cuts, n: int) -> DataFrame:
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return cuts.write(f"grand-{n}", parents.join(above.hint("merge"), "parent"))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """[SO2] node: everything in the components of start (node), and start itself."""
    found = components(edges)
    own = found.join(start.select("node"), "node", "left_semi").select("component").distinct()
    return found.join(own, "component", "left_semi").select("node").unionByName(start.select("node")).distinct()
