"""Closures of relations to their fixpoint: ancestors by pointer jumping, reachability by new pairs alone, levels by peeling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Rounds

#: Findings on a hierarchy.
CYCLE, ABSENT_PARENT = "SECTION_CYCLE", "SECTION_PARENT_ABSENT"


def ancestors(sections: DataFrame) -> DataFrame:
    """(section, ancestor) for every section and each section above it, itself included; ``sections`` has section and parent, of any depth.

    Pointer jumping: after round k every section knows what lies less than 2**k steps above it and what lies 2**k steps above, so it takes over what that one
    knows. The rounds are the logarithm of the depth; each is a written table. On a circle they end when a round finds no new pair. Sections without
    a row of their own are nobody's ancestor; null ids are left out, and a section with several parents climbs to all.
    """
    with Rounds(sections.sparkSession) as rounds:
        known = sections.select("section").filter("section is not null").distinct()
        steps = sections.select("section", F.col("parent").alias("up")).filter("parent is not null").join(known.withColumnRenamed("section", "up"), "up", "left_semi")
        jumps = rounds.keep(steps.filter("section is not null").distinct())
        pairs, n = rounds.keep(known.select("section", F.col("section").alias("ancestor"))), -1
        while not jumps.isEmpty() and n != (n := pairs.count()):
            higher = pairs.select(F.col("section").alias("up"), "ancestor")
            more = rounds.keep(pairs.unionByName(jumps.join(higher, "up").select("section", "ancestor")).distinct())
            twice = rounds.keep(jumps.join(jumps.select(F.col("section").alias("up"), F.col("up").alias("further")), "up").select("section", F.col("further").alias("up")).distinct())
            rounds.drop(pairs, jumps)
            pairs, jumps = more, twice
        return rounds.result(pairs)


def hierarchy_findings(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(code, target) for sections that lie on a circle (``pairs``: their ancestors) and for parents that are no section."""
    up = sections.filter("parent is not null and section is not null").select("section", "parent").distinct()
    own = pairs.select(F.col("section").alias("parent"), F.col("ancestor").alias("section"))
    circle = up.join(own, ["parent", "section"], "left_semi").select(F.lit(CYCLE).alias("code"), F.col("section").alias("target")).distinct()
    absent = up.join(sections.select(F.col("section").alias("parent")).distinct(), "parent", "left_anti").select(F.lit(ABSENT_PARENT).alias("code"), F.col("parent").alias("target")).distinct()
    return circle.unionByName(absent)


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node): what each start reaches over edges (a, b), itself too, within ``max_depth`` edges or, by default, however far.

    Each round extends the pairs that the last one found, and writes those that are new; circles end where nothing is new.
    """
    edges = edges.filter("a is not null and b is not null").select("a", "b").distinct()
    with Rounds(edges.sparkSession) as rounds:
        edges = rounds.keep(edges)
        new = rounds.keep(starts.select("start", F.col("start").alias("node")).distinct())
        parts, depth = [new], 0
        while (max_depth is None or depth < max_depth) and not new.isEmpty():
            step = new.join(edges, new["node"] == edges["a"]).select("start", F.col("b").alias("node")).distinct()
            new = rounds.keep(step.join(_all(parts), ["start", "node"], "left_anti"))
            parts.append(new)
            depth += 1
        return rounds.result(_all(parts))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the length of the longest way to each node over edges (a, b), which orders the graph; null on a circle and below one.

    A round takes the nodes that wait for nothing, and counts their edges off those that wait: every edge is joined once, in the round of its beginning. A graph
    has as many rounds as levels.
    """
    edges = edges.filter("a is not null and b is not null").select("a", "b").distinct()
    with Rounds(edges.sparkSession) as rounds:
        edges = rounds.keep(edges)
        nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        waits = edges.groupBy(F.col("b").alias("node")).agg(F.count("a").alias("left"))
        waiting = rounds.keep(nodes.join(waits, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left")))
        done, depth = [], 0
        while True:
            now = rounds.keep(waiting.filter("left = 0").select("node", F.lit(depth).cast("long").alias("level")))
            if now.isEmpty():
                break
            done.append(now)
            gone = now.join(edges, now["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.count("a").alias("gone"))
            rest = rounds.keep(waiting.filter("left > 0").join(gone, "node", "left").select("node", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")))
            rounds.drop(waiting)
            waiting, depth = rest, depth + 1
        return rounds.result(_all([*done, waiting.select("node", F.lit(None).cast("long").alias("level"))]))
