"""Evidence packs of many cases in one plan, with the context that anchors need; cases whose pack misses something are planned again with wider limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Rounds
from .search import pack_greedily

#: Kinds of elements whose neighbouring prose is needed to understand them.
TYPED = "equation figure figure_context table algorithm pseudocode".split()


@dataclass(frozen=True)
class Limits:
    """Candidates, blocks and bytes of a pack."""

    candidates: int
    blocks: int
    size: int


#: The limits of a first pack, and of one that is planned again.
ROUNDS = (Limits(5, 12, 16_000), Limits(12, 20, 24_000))


def beside(elements: DataFrame) -> DataFrame:
    """(case, element, near): every element with those one position before and after it in its section; ``elements`` has case, element, position, section. An equi-join on positions."""
    to = elements.select("case", "section", F.col("element").alias("near"), F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position"))
    return elements.select("case", "section", "position", "element").join(to, ["case", "section", "position"]).select("case", "element", "near")


def explanations(elements: DataFrame, near: DataFrame) -> DataFrame:
    """(case, element, near): the prose beside each typed element that explains it: a paragraph of its section and page that is no noise. A page that isn't known is any."""
    typed = elements.filter(F.col("kind").isin(*TYPED)).select("case", "element", F.col("page").alias("own_page"))
    prose = elements.filter((F.col("kind") == "paragraph") & ~F.col("noise")).select("case", F.col("element").alias("near"), "page")
    return near.join(typed, ["case", "element"]).join(prose, ["case", "near"]).filter(F.col("own_page").isNull() | (F.col("own_page") == F.col("page"))).select("case", "element", "near")


def _planned(pending: DataFrame, limits: Limits, ranked: DataFrame, found: DataFrame, near: DataFrame, prose: DataFrame, elements: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """One round over the cases in ``pending``: their packs (case, place, element), and per case what is missing."""
    own = lambda df: df.join(pending, "case", "left_semi")
    candidates = own(ranked)
    # each reference's best, in the order of references; an element protects the first that names it
    best = own(found).join(candidates.select("case", "element", "rank"), ["case", "element"]).groupBy("case", "reference").agg(F.min_by("element", "rank").alias("element"))
    protected = best.groupBy("case", "element").agg(F.min("reference").alias("reference"))
    taken = protected.withColumn("slot", F.row_number().over(W.partitionBy("case").orderBy("reference")))
    count = taken.groupBy("case").agg(F.count("slot").alias("n"))
    others = candidates.join(protected, ["case", "element"], "left_anti").withColumn("k", F.row_number().over(W.partitionBy("case").orderBy("rank"))).filter(F.col("k") <= limits.candidates)
    others = others.join(count, "case", "left").filter(F.col("k") <= limits.candidates - F.coalesce("n", F.lit(0)))
    selected = taken.select("case", "element", "slot", F.lit(True).alias("protected")).unionByName(others.select("case", "element", (F.col("k") + 1_000_000).alias("slot"), F.lit(False).alias("protected")))
    first = F.row_number().over(W.partitionBy("case").orderBy("slot")) == 1
    selected = selected.withColumn("first", first).join(count, "case", "left").withColumn("primary", F.col("protected") | (F.col("n").isNull() & F.col("first"))).drop("n", "first")
    selected = rounds.keep(selected)

    quiet = elements.filter(~F.col("noise")).select("case", F.col("element").alias("near"))
    around = selected.select("case", "element", "slot").join(near, ["case", "element"]).join(quiet, ["case", "near"]).groupBy("case", F.col("near").alias("element")).agg(F.min("slot").alias("slot"))
    around = around.join(selected, ["case", "element"], "left_anti")
    both = selected.select("case", "element", "slot", "primary").unionByName(around.select("case", "element", (F.col("slot") + 2_000_000).alias("slot"), F.lit(False).alias("primary")))
    needed = both.select("case", "element").join(prose, ["case", "element"]).select("case", F.col("near").alias("element")).distinct().withColumn("needed", F.lit(True))
    position = elements.select("case", "element", "position", "size")
    # anchors, then the prose they need, then the other candidates and what lies beside them
    group = F.when(F.col("primary"), 0).when(F.col("needed"), 1).otherwise(2)
    every = both.join(needed, ["case", "element"], "full_outer").join(position, ["case", "element"])
    order = F.row_number().over(W.partitionBy("case").orderBy(group, F.coalesce("slot", F.lit(9_000_000)), "position"))
    ordered = rounds.keep(every.select("case", "element", F.coalesce("needed", F.lit(False)).alias("needed"), F.col("size").cast("long").alias("size"), order.alias("place")))
    kept = _packed(ordered, limits)
    packs = rounds.keep(ordered.join(kept, ["case", "place"]).select("case", "block", "element", "needed"))
    inside = packs.select("case", "element")
    held = own(found).join(inside, ["case", "element"], "left_semi").select("case", "reference").distinct()
    lost = own(found).select("case", "reference").distinct().join(held, ["case", "reference"], "left_anti").groupBy("case").agg(F.count("reference").alias("missing_references"))
    bare = ordered.filter("needed").join(inside, ["case", "element"], "left_anti").groupBy("case").agg(F.count("element").alias("missing_context"))
    sizes = ordered.groupBy("case").agg(F.count("element").alias("n")).join(packs.groupBy("case").agg(F.count("element").alias("blocks")), "case", "left")
    told = pending.join(sizes, "case", "left").join(lost, "case", "left").join(bare, "case", "left").fillna(0, ["n", "blocks", "missing_references", "missing_context"])
    return packs.select("case", "block", "element"), rounds.keep(told.withColumn("limited", F.col("n") > F.col("blocks")).drop("n"))


def _packed(ordered: DataFrame, limits: Limits) -> DataFrame:
    kept = pack_greedily(ordered.select("case", "place", "size"), "case", "place", "size", limits.blocks, limits.size)
    # the packing names its own order ``place`` too
    return kept.toDF("case", "block", "place")


def evidence_packs(cases: DataFrame, ranked: DataFrame, found: DataFrame, elements: DataFrame, limits: tuple[Limits, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Packs (case, block, element) and a report (case, round, blocks, missing_references, missing_context, limited).

    ``cases``: case. ``ranked``: case, element, rank (1 is best) of the candidates. ``found``: case, reference (a number: their order), element, what references name.
    ``elements``: case, element, position, section, page, kind, noise, size.

    A pack begins with its anchors, the best element of each reference (without any, the best candidate), then the prose that typed elements need, then
    other candidates and the elements beside them, as far as they fit. All cases are one plan. Those whose pack lacks a reference or needed prose go into
    the next round with its limits, the rest pass through as they are; the last round's pack counts whatever it lacks.
    """
    with Rounds(cases.sparkSession) as rounds:
        elements, ranked, found = (rounds.keep(df) for df in (elements, ranked.select("case", "element", "rank"), found.select("case", "reference", "element").distinct()))
        near = rounds.keep(beside(elements))
        prose = rounds.keep(explanations(elements, near))
        pending, packs, reports = rounds.keep(cases.select("case").distinct()), [], []
        for k, limit in enumerate(limits, 1):
            pack, told = _planned(pending, limit, ranked, found, near, prose, elements, rounds)
            again = (F.col("missing_references") > 0) | (F.col("missing_context") > 0) if k < len(limits) else F.lit(False)
            done = told.filter(~again)
            packs.append(pack.join(done.select("case"), "case", "left_semi"))
            reports.append(done.select("case", F.lit(k).alias("round"), F.col("blocks").cast("long").alias("blocks"), "missing_references", "missing_context", "limited"))
            pending = rounds.keep(told.filter(again).select("case"))
            if pending.isEmpty():
                break
        for part in packs[1:]:
            packs[0] = packs[0].unionByName(part)
        for part in reports[1:]:
            reports[0] = reports[0].unionByName(part)
        return rounds.result(packs[0]), rounds.result(reports[0])
