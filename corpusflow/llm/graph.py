"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_SENT, Scratch, stage


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that can be reached; a table written by ``keep``.

    Each round, every node joins the neighbour of greatest priority (or itself), and edges between joined nodes are what is left.
    Two rounds of three, nodes with more neighbours come first, so that groups about hubs go in a round or two; hashes decide between equals, and in each third
    round alone. These change by round, so chains stay short there and the nodes left shrink by a constant factor; each round is a written table,
    deleted once the next is there. Loops and repeated edges do no harm.
    """
    with Scratch(edges.sparkSession) as scratch:
        left = scratch.stage(edges.select("a", "b").filter("a != b").distinct(), "edges")
        nodes = scratch.stage(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("now", F.col("node")), "nodes")
        step = 0
        while edges_left := left.count():
            both = left.union(left.select("b", "a"))
            rank = lambda c, n: F.struct(n.alias("neighbours"), F.xxhash64(F.lit(step), c).alias("draw"), F.col(c).alias("id"))  # noqa: B023, E731
            if step % 3 < 2:
                counts = both.groupBy("a").agg(F.count("b").alias("n")).withColumnRenamed("a", "b")
                # a table of its own where it is large, so that the join may be split at a hub
                counts = F.broadcast(counts) if 2 * edges_left <= MAX_SENT else scratch.stage(counts, "counts")
                met, of_b, of_a = both.join(counts, "b"), F.col("n"), F.col("own")
            else:
                met, of_b, of_a = both, F.lit(0).cast("long"), F.lit(0).cast("long")
            joined = met.groupBy("a").agg(F.max(rank("b", of_b)).alias("best"), F.count("b").alias("own"))
            joined = scratch.stage(joined.select(F.col("a").alias("was"), F.greatest(F.col("best"), rank("a", of_a))["id"].alias("to")), "joined")
            now = scratch.stage(nodes.join(joined, F.col("now") == F.col("was"), "left").select("node", F.coalesce("to", "now").alias("now")), "nodes")
            moved = left.join(joined.select(F.col("was").alias("a"), F.col("to").alias("x")), "a").join(joined.select(F.col("was").alias("b"), F.col("to").alias("y")), "b")
            rest = scratch.stage(moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
            scratch.drop(nodes, left, joined)
            nodes, left, step = now, rest, step + 1
        roots = nodes.groupBy("now").agg(F.min("node").alias("component"))
        return keep(nodes.join(roots, "now").select("node", "component"), "components")
