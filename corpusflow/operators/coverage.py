"""Whether a lesson covers its focus: what each control reaches in the graph of computations, as bitmaps, and set tests on these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Rounds
from .within import by_case, led_to, split_by_size

#: A request for editable inputs in a focus, and a name in it.
EDITABLE = r"(?i)\beditable\s+([A-Za-z][A-Za-z0-9_]*(?:\s*,\s*[A-Za-z][A-Za-z0-9_]*)*(?:\s*,?\s+and\s+[A-Za-z][A-Za-z0-9_]*)?)\s+(?:inputs|values|vectors|matrices|parameters)\b"
NAMED = r"([A-Za-z][A-Za-z0-9_]*)"
#: The lists of a coverage map.
FIELDS = "learning_objective mechanism control computation visual exploration".split()
WORD = 64


def editable_requests(focus: Column) -> Column:
    """The names that a focus asks to have as editable inputs, in lower case, in order."""
    lists = F.regexp_extract_all(focus, F.lit(EDITABLE), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(F.lower(x), F.lit(NAMED), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda x: x != "and"))


def numbered(marks: DataFrame) -> DataFrame:
    """(case, node, word, bits): each node of ``marks`` (case, node) as one bit, numbered within its case."""
    at = F.row_number().over(W.partitionBy("case").orderBy("node")) - 1
    return marks.select("case", "node").distinct().withColumn("at", at).select("case", "node", F.floor(F.col("at") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(at % {WORD} AS INT))").alias("bits"))


def downstream(edges: DataFrame, marks: DataFrame, most: int | None = None) -> DataFrame:
    """(case, node, word, bits): which marked nodes (``numbered``) each node leads to over edges (case, a, b), itself included; nodes that lead to none have no row.

    Edges stay within a case, so a task takes many whole cases and sends bits from each node to those that lead to it until none changes. Cases with more than ``most`` edges, and those that aren't
    numbers, go level by level over all of them at once (``_by_rounds``); so does nothing else.
    """
    kinds = dict(edges.dtypes), dict(marks.dtypes)
    edges, marks = edges.select("case", "a", "b"), marks.select("case", "node", "word", "bits")
    if not all(k["case"] in ("int", "bigint") for k in kinds) or kinds[0]["a"] != "string" or kinds[1]["node"] != "string":
        return _by_rounds(edges, marks)
    apart = []
    if (large := split_by_size(edges, most)) is not None:
        apart = [_by_rounds(edges.join(large, "case", "left_semi"), marks.join(large, "case", "left_semi"))]
        edges, marks = edges.join(large, "case", "left_anti"), marks.join(large, "case", "left_anti")
    nameless = marks.filter("case is null or node is null")
    told = edges.filter("case is not null and a is not null and b is not null").select("case", "a", "b", F.lit(None).cast("int").alias("word"), F.lit(None).cast("bigint").alias("bits"))
    told = told.unionByName(marks.filter("case is not null and node is not null").select("case", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "word", "bits"))
    out = by_case(told, led_to, f"case {kinds[0]['case']}, node string, word int, bits bigint").unionByName(nameless)
    for part in apart:
        out = out.unionByName(part)
    with Rounds(edges.sparkSession) as rounds:
        return rounds.result(out)


def _by_rounds(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """``downstream`` level by level: a round sends on the words that the last one changed, and an aggregate merges what arrives by ``bit_or``, so descendants that are reached on many ways are counted
    once and a set of 64 is one number. Circles end when no word changes."""
    with Rounds(edges.sparkSession) as rounds:
        back = rounds.keep(edges.select("case", F.col("b").alias("node"), F.col("a").alias("to")).distinct())
        known = changed = rounds.keep(marks.select("case", "node", "word", "bits"))
        while not changed.isEmpty():
            sent = changed.join(back, ["case", "node"]).groupBy("case", F.col("to").alias("node"), "word").agg(F.bit_or("bits").alias("more"))
            both = rounds.keep(known.join(sent, ["case", "node", "word"], "full_outer").withColumn("old", F.coalesce("bits", F.lit(0))).withColumn("bits", F.col("old").bitwiseOR(F.coalesce("more", F.lit(0)))))
            changed = both.filter("bits != old").select("case", "node", "word", "bits")
            known = both.select("case", "node", "word", "bits")
        return rounds.result(known)


@dataclass
class Coverage:
    """Tables over any number of cases; each has ``case``, and:

    maps: focus (that of the coverage map; no row: no map), wanted (that of the evidence). refs: field, ref (the map's lists, repeats kept). valid: field, ref. variables: id, symbol.
    controls: id, variable. effects: id, ref (a control's). inputs: id, ref (a computation's inputs and dependencies). outputs: id, ref. data: id, ref (a visual's).
    involved: id, ref (a mechanism's variables). setups: id, ref (an exploration's controls).
    """

    cases: DataFrame
    maps: DataFrame
    refs: DataFrame
    valid: DataFrame
    variables: DataFrame
    controls: DataFrame
    effects: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    data: DataFrame
    involved: DataFrame
    setups: DataFrame


def _code(df: DataFrame, code: str, target: str) -> DataFrame:
    return df.select("case", F.lit(code).alias("code"), F.col(target).cast("string").alias("target"))


def coverage_findings(t: Coverage) -> DataFrame:
    """(case, code, target): what the map lacks, and which covered parts lead to nothing that the lesson computes or shows. A case without a map has that finding only."""
    has = t.maps.select("case")
    t = Coverage(**{k: v if k in ("cases", "maps") else v.join(has, "case", "left_semi") for k, v in vars(t).items()})
    bare = _code(t.cases.select("case").join(has, "case", "left_anti").withColumn("target", F.lit(None).cast("string")), "MISSING_MAP", "target")
    moved = _code(t.maps.filter(~F.col("focus").eqNullSafe(F.col("wanted"))).withColumn("target", F.lit("focus")), "FOCUS_CHANGED", "target")

    asked = t.maps.select("case", F.explode(editable_requests(F.col("wanted"))).alias("symbol"))
    controlled = t.variables.join(t.controls.select("case", F.col("variable").alias("id")), ["case", "id"], "left_semi").select("case", F.lower("symbol").alias("symbol"))
    fixed = _code(asked.join(controlled, ["case", "symbol"], "left_anti"), "EDITABLE_WITHOUT_CONTROL", "symbol")

    every = has.withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    listed = t.refs.groupBy("case", "field", "ref").agg(F.count(F.lit(1)).alias("n")).join(t.valid.select("case", "field", "ref").distinct().withColumn("fine", F.lit(True)), ["case", "field", "ref"], "left")
    listed = listed.groupBy("case", "field").agg(F.bool_and((F.col("n") == 1) & F.coalesce("fine", F.lit(False))).alias("fine"))
    lists = _code(every.join(listed, ["case", "field"], "left").filter(~F.coalesce("fine", F.lit(False))), "INVALID_REFS", "field")

    covered = lambda field: t.refs.filter(F.col("field") == field).select("case", F.col("ref").alias("id")).distinct()
    selected = covered("computation")
    with Rounds(t.cases.sparkSession) as rounds:
        node = lambda df, c: df.select("case", F.col(c).alias("node"))
        bits = rounds.keep(numbered(node(selected, "id").union(node(t.data, "ref")).union(node(t.effects, "ref"))))
        edges = t.inputs.select("case", F.col("ref").alias("a"), F.col("id").alias("b")).union(t.outputs.select("case", F.col("id").alias("a"), F.col("ref").alias("b")))
        reached = downstream(edges, bits)
        mask = lambda df, name: df.join(bits, ["case", "node"]).groupBy("case", "word").agg(F.bit_or("bits").alias(name))
        own = t.controls.select("case", "id", F.col("variable").alias("node")).join(reached, ["case", "node"])
        meets = own.join(mask(node(selected, "id"), "computed"), ["case", "word"], "left").join(mask(node(t.data, "ref"), "seen"), ["case", "word"], "left")
        both = lambda c: F.bool_or(F.coalesce(F.col("bits").bitwiseAND(F.col(c)) != 0, F.lit(False))).alias(c)
        meets = meets.groupBy("case", "id").agg(both("computed"), both("seen"))
        wanted = t.effects.select("case", "id", F.col("ref").alias("node")).join(bits, ["case", "node"]).groupBy("case", "id", "word").agg(F.bit_or("bits").alias("effects"))
        missed = wanted.join(own.select("case", "id", "word", "bits"), ["case", "id", "word"], "left").filter(F.expr("(effects & ~coalesce(bits, 0L)) != 0")).select("case", "id").distinct().withColumn("missed", F.lit(True))
        judged = t.controls.select("case", "id").join(meets, ["case", "id"], "left").join(missed, ["case", "id"], "left")
        no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
        unused = _code(judged.filter(no("computed")).join(covered("control"), ["case", "id"], "left_semi"), "CONTROL_UNUSED", "id")
        unseen = _code(judged.filter(no("seen") | F.coalesce("missed", F.lit(False))), "CONTROL_WITHOUT_EFFECT", "id")
        paths = rounds.result(unused.unionByName(unseen))

    made = t.outputs.join(selected, ["case", "id"], "left_semi").select("case", "ref")
    taken = t.inputs.join(selected, ["case", "id"], "left_semi").select("case", "ref").union(made).distinct()
    mechanisms = covered("mechanism").join(t.valid.filter("field = 'mechanism'").select("case", F.col("ref").alias("id")), ["case", "id"], "left_semi")
    apart = _code(mechanisms.join(t.involved.join(taken, ["case", "ref"], "left_semi"), ["case", "id"], "left_anti"), "MECHANISM_DISCONNECTED", "id")
    produced = selected.select("case", F.col("id").alias("ref")).union(made).distinct()
    there = lambda field: covered(field).join(t.valid.filter(F.col("field") == field).select("case", F.col("ref").alias("id")), ["case", "id"], "left_semi")
    blind = _code(there("visual").join(t.data.join(produced, ["case", "ref"], "left_semi"), ["case", "id"], "left_anti"), "VISUAL_DISCONNECTED", "id")
    idle = _code(there("exploration").join(t.setups.join(covered("control").withColumnRenamed("id", "ref"), ["case", "ref"], "left_semi"), ["case", "id"], "left_anti"), "EXPLORATION_IDLE", "id")
    out = bare
    for part in (moved, fixed, lists, paths, apart, blind, idle):
        out = out.unionByName(part)
    return out
