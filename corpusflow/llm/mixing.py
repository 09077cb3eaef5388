"""Mixing sources to target weights: min-cost flow of token capacity from membership patterns to source quotas."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_SENT, Scratch, documents, row_keys, running_totals, sent, stage

#: Fixed values of the query: weights by rank of the source, and the most times a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a hash range, about; ranges are taken whole, but for those at an edge, whose documents are ordered. Ranges at least.
PER_RANGE, RANGES = 2000, 4096
#: No source, where null is one.
_NONE = object()


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of all sizes by weight; none above ``most`` times its source, the excess shared again by weight."""
    total, out, free = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        left, weight = total - sum((out[i] for i in range(len(sizes)) if i not in free), Fraction(0)), sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / weight
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        free -= above
    return out


def parts_of(patterns: dict[tuple, int]) -> list[dict[tuple, int]]:
    """The patterns by connected component: patterns of different parts have no source in common, so each part's flow is its own."""
    parent: dict = {}

    def root(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[root(s)] = root(p[0])
    out: dict = {}
    for p, v in patterns.items():
        if p:
            out.setdefault(root(p[0]), {})[p] = v
    return list(out.values())


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple[tuple, int, object], Fraction]:
    """Words that each pattern's n-th copy gives each source; a word's n-th use costs n - 1, which makes the costs convex.

    Successive cheapest augmenting paths over (pattern, copy) -> source: copy by copy, a copy's words go to sources that still
    need some, and already routed words move to other sources of their pattern where that frees a place. Costs depend on the copy
    alone, so filling the copies in order, each by a maximal flow, is the cheapest flow of the most words.
    """
    flow: dict[tuple[tuple, int, object], Fraction] = {}
    need = dict(quotas)
    for n in range(most):
        room = {p: Fraction(v) for p, v in patterns.items()}
        while True:
            # breadth first from patterns with room to a source that needs words
            seen: dict = {}
            front: list = []
            for p in sorted(room, key=repr):
                if room[p] > 0:
                    for s in p:
                        if s not in seen:
                            seen[s] = (p, n, _NONE)
                            front.append(s)
            end = _NONE
            while front and end is _NONE:
                s = front.pop(0)
                if need.get(s, 0) > 0:
                    end = s
                    break
                for (p, m, t), v in list(flow.items()):
                    if t == s and v > 0:
                        for other in p:
                            if other not in seen:
                                seen[other] = (p, m, s)
                                front.append(other)
            if end is _NONE:
                break
            steps, s = [], end
            while True:
                p, m, via = seen[s]
                steps.append((p, m, s, via))
                if via is _NONE:
                    break
                s = via
            amount = min([need[end], room[steps[-1][0]], *(flow[(p, m, via)] for p, m, _, via in steps if via is not _NONE)])
            for p, m, to, via in steps:
                flow[(p, m, to)] = flow.get((p, m, to), Fraction(0)) + amount
                if via is not _NONE:
                    flow[(p, m, via)] -= amount
            need[end] -= amount
            room[steps[-1][0]] -= amount
    return {k: v for k, v in flow.items() if v > 0}


def measured(docs: DataFrame, size: Column, memberships: Column, seed: int, ranges: int) -> DataFrame:
    """``docs`` as one column ``row``, and size, sources, their pattern, the row's keys k1 and k2, its draw by a seeded hash of these, and the
    hash range it lies in. Equal draws differ in their keys, unless rows have the same id and text."""
    # null is a source too: as text, patterns with it are equal like others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), memberships.alias("sources"), *row_keys("doc_id", "text"))
    rows = rows.withColumn("pattern", F.to_json("sources")).withColumn("draw", F.xxhash64(F.lit(seed), "k1", "k2"))
    return rows.withColumn("range", F.shiftrightunsigned("draw", 64 - (ranges.bit_length() - 1)).cast("long"))


class Mix:
    """How many words to take from each document so that each source comes near its target.

    Documents belong to one or several sources (a null source is one like any other) and are aggregated by membership pattern; the
    driver sees one row per pattern, and solves each group of patterns that share sources by itself. The flow says how many words each
    pattern's n-th copy gives each source; there, documents in the order of a seeded hash are taken whole while they fit, up to the
    middle of the document at the edge. Hash ranges are summed first, so that only ranges at an edge are ordered, by ranged buckets.

    ``small``: per row size, pattern, k1, k2, draw, range and ``nth`` (tells rows of one id and text apart). ``plan``: per pattern the
    flows (source, n, ranges from and to that it takes whole) and the ranges that are cut. ``cut``: the takes of each row of those.
    ``goals``: source, source_size, target.
    """

    def __init__(self, docs: DataFrame, size: Column, memberships: Column, scratch: Scratch, seed: int = 7, most: int = MOST, carry: tuple[str, ...] = ()):
        spark, self.scratch, self.seed = docs.sparkSession, scratch, seed
        self.ranges = RANGES
        n = docs.count()
        while self.ranges * PER_RANGE < n:
            self.ranges *= 2
        rows = measured(docs, size, memberships, seed, self.ranges).select("*", *[F.col(f"row.`{c}`") for c in carry]).drop("row")
        self.small = scratch.stage(rows.withColumn("nth", F.monotonically_increasing_id()), "sized")
        sums = scratch.stage(self.small.groupBy("pattern", "range").agg(F.sum("size").alias("words"), F.first("sources").alias("sources")), "ranges")
        found = sums.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("sources").alias("sources")).collect()
        have = {tuple(r["sources"]): r["words"] for r in found}
        named = {tuple(r["sources"]): r["pattern"] for r in found}
        sources = sorted({s for p in have for s in p}, key=lambda s: (s is None, s))
        own = dict.fromkeys(sources, 0)
        for p, v in have.items():
            for s in set(p):
                own[s] += v
        goal = dict(zip(sources, targets([own[s] for s in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))], most), strict=True))
        routed: dict = {}
        for part in parts_of(have):
            routed |= min_cost_flow(part, {s: goal[s] for p in part for s in p}, most)
        cuts = []
        for p in have:
            for k in range(most):
                at = Fraction(0)
                for s in sorted(set(p), key=lambda s: (s is None, s)):
                    if v := routed.get((p, k, s)):
                        cuts.append((named[p], k, s, float(at), float(at + v)))
                        at += v
        element = self.small.schema["sources"].dataType.elementType.simpleString()
        flows = spark.createDataFrame(cuts, f"p string, n int, source {element}, from_word double, to_word double")
        flows = F.broadcast(flows) if len(cuts) <= MAX_SENT else flows
        self.goals = spark.createDataFrame([(s, own[s], float(goal[s])) for s in sources], f"source {element}, source_size long, target double")
        # words before each range within its pattern
        before = sums.select("pattern", "range", "words", (F.sum("words").over(W.partitionBy("pattern").orderBy("range")) - F.col("words")).alias("before"))
        met = before.join(flows, (F.col("pattern") == F.col("p")) & (F.col("to_word") > F.col("before")) & (F.col("from_word") < F.col("before") + F.col("words"))).drop("p")
        whole = (F.col("from_word") <= F.col("before")) & (F.col("to_word") >= F.col("before") + F.col("words"))
        met = scratch.stage(met.withColumn("whole", whole), "met")
        cut = met.groupBy("pattern", "range").agg(F.first("before").alias("before"), F.bool_and("whole").alias("whole"), F.collect_list(F.struct("source", "from_word", "to_word", "n")).alias("flows")).filter("not whole").drop("whole")
        cut = scratch.stage(cut, "cut-ranges")
        lines = met.filter("whole").groupBy("pattern", "source", "n").agg(F.min("range").alias("low"), F.max("range").alias("high"))
        plan = lines.groupBy("pattern").agg(F.collect_list(F.struct("source", "n", "low", "high")).alias("lines"))
        plan = plan.join(cut.groupBy("pattern").agg(F.collect_list("range").alias("cuts")), "pattern", "full")
        self.plan = scratch.stage(plan, "plan")
        edge = self.small.join(sent(cut.select("pattern", "range")), ["pattern", "range"], "left_semi").drop("sources")
        edge = running_totals(edge, ["pattern", "range", "draw", "k1", "k2", "nth"], "size", "at", scratch.stage)
        edge = scratch.stage(edge, "edge")
        first = edge.groupBy("pattern", "range").agg(F.min("at").alias("first"))
        placed = edge.join(first, ["pattern", "range"]).join(cut, ["pattern", "range"])
        middle = F.col("before") + F.col("at") - F.col("first") + F.col("size") / 2
        takes = F.filter("flows", lambda t: (t["from_word"] < middle) & (middle <= t["to_word"]))
        takes = F.transform(takes, lambda t: F.struct(t["source"].alias("source"), t["n"].alias("n")))
        self.cut = scratch.stage(placed.select("k1", "k2", "nth", takes.alias("cut_takes")), "cut-takes")


def by_plan(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (of ``measured`` or ``Mix.small``) with ``is_cut`` and, for those in ranges taken whole or not at all, ``takes``: an array with an entry
    (source, n) for each copy taken. Sizes of 0 are never taken."""
    told = rows.join(sent(plan), "pattern", "left")
    lines = F.filter("lines", lambda t: (t["low"] <= F.col("range")) & (F.col("range") <= t["high"]))
    lines = F.transform(lines, lambda t: F.struct(t["source"].alias("source"), t["n"].alias("n")))
    is_cut = F.coalesce(F.array_contains("cuts", F.col("range")), F.lit(False)) & (F.col("size") > 0)
    return told.withColumn("is_cut", is_cut).withColumn("takes", F.when(F.col("size") > 0, lines)).drop("lines", "cuts")


def mix_sources(docs: DataFrame, size: Column, memberships: Column, carry: tuple[str, ...] = (), seed: int = 7, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: its columns ``carry``, size, sources and ``takes``, an array with an entry (source, n) for each copy taken, empty or
    null where there is none; and per source: source, source_size, target. See ``Mix``.

    Which rows are taken follows from their ids and texts alone, so reruns agree; rows equal in both are interchangeable. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        mix = Mix(docs, size, memberships, scratch, seed, most, carry)
        told = by_plan(mix.plan, mix.small).join(sent(mix.cut.select("nth", "cut_takes")), "nth", "left")
        told = told.select(*carry, "size", "sources", F.when(F.col("is_cut"), F.col("cut_takes")).otherwise(F.col("takes")).alias("takes"))
        return stage(told, "mixed"), stage(mix.goals, "goals")


def taken_rows(docs: DataFrame, size: Column, memberships: Column, seed: int = 7, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, texts never shuffled: ranges and the few rows at edges are sent to them instead.

    Rows of size 0 fill no quota and stay as they are. Of rows that are equal in id and text and lie at an edge, one stands for all.
    """
    with Scratch(docs.sparkSession) as scratch:
        mix = Mix(docs, size, memberships, scratch, seed, most)
        # what the edges give each id and text
        cut = mix.cut.groupBy("k1", "k2").agg(F.sum(F.size("cut_takes")).alias("cut_times"), F.count("nth").alias("alike"))
        cut = scratch.stage(cut, "cut-times")
        plain, alike = stage(cut.filter("alike = 1").drop("alike"), "cut-plain"), stage(cut.filter("alike > 1").drop("alike"), "cut-alike")
        plan = stage(mix.plan, "plan")
    told = by_plan(plan, measured(docs, size, memberships, seed, mix.ranges))
    calm = F.when(F.col("size") == 0, 1).otherwise(F.coalesce(F.size("takes"), F.lit(0)))
    told = told.join(sent(plain), ["k1", "k2"], "left").withColumn("times", F.when(F.col("is_cut"), F.coalesce("cut_times", F.lit(0))).otherwise(calm).cast("int"))
    out = told.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    if not alike.isEmpty():
        few = told.filter("is_cut").drop("cut_times").join(sent(alike), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        out = out.unionByName(few.filter("cut_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("cut_times").cast("int")))))
    return out.select("row.*")


def words_of(docs: DataFrame) -> Column:
    return F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")


def op10_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    told, goals = mix_sources(docs, words_of(docs), F.array("source"), ("doc_id",))
    told = told.withColumn("own", F.element_at("sources", 1)).join(sent(goals), F.col("own").eqNullSafe(F.col("source")), "left")
    return told.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce(F.size("takes"), F.lit(0))).cast("long").alias("taken"))
