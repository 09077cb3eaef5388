"""Manifests of lessons: whether their parts fit together, as findings over the parts' tables, and the manifests as JSON documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Rounds
from .closure import levels
from .coverage import downstream, numbered
from .within import by_case, peeled, split_by_size

#: The least controls and the explorations of a lesson.
LEAST_CONTROLS, EXPLORATIONS = 2, 2


@dataclass
class Manifest:
    """Tables over any number of manifests; each has ``case``, and:

    variables: id, type. initial: id, value (JSON text). controls: id, variable, first (its default, JSON text). effects: id (a control's), ref. computations: id, place, type.
    reads: id (a computation's), ref, as declared. used: id, ref, as its expression names them. outputs: id, ref. visuals: id. data: id (a visual's), ref. explorations: id, complete.
    """

    cases: DataFrame
    variables: DataFrame
    initial: DataFrame
    controls: DataFrame
    effects: DataFrame
    computations: DataFrame
    reads: DataFrame
    used: DataFrame
    outputs: DataFrame
    visuals: DataFrame
    data: DataFrame
    explorations: DataFrame


def _found(df: DataFrame, code: str, target: Column) -> DataFrame:
    return df.select("case", F.lit(code).alias("code"), target.cast("string").alias("target"))


def manifest_findings(t: Manifest) -> DataFrame:
    """(case, code, target), distinct, of every rule that a manifest breaks. Each rule is a grouped or joined pass over all manifests, so none waits for another.

    DUPLICATE_VARIABLE, DUPLICATE_ID (over all that run), DUPLICATE_CONTROL (of one variable); FEW_CONTROLS, NOT_TWO_EXPLORATIONS, NO_VISUALS, NO_COMPUTATIONS; READS_DIFFER (declared from used), NO_OUTPUT,
    OUTPUT_TYPE (a variable of another type), OUTPUT_TWICE, OUTPUT_IS_INITIAL, UNKNOWN_STATE (initial or produced, but no variable), WITHOUT_VALUE (a variable that is neither), UNRESOLVED_READ (neither),
    CIRCLE and OUT_OF_ORDER (computations stand by the round in which all that they read is there), DEFAULT_DIFFERS (from the initial value), INCOMPLETE_EXPLORATION, UNKNOWN_DATA, UNKNOWN_EFFECT,
    DEAD_CONTROL (leads to no output or to nothing shown) and EFFECT_NOT_REACHED (a variable, computation or visual that it has no path to). Null ids and refs name nothing and are left out.
    """
    t = Manifest(**{k: v.filter(" and ".join(f"{c} is not null" for c in ("case", "id", "ref") if c in v.columns)) for k, v in vars(t).items()})
    ids = lambda df, c="id": df.select("case", F.col(c).alias("id")).filter("id is not null").distinct()
    variables, initial, computed = ids(t.variables), ids(t.initial), ids(t.outputs, "ref")
    running = [df.select("case", "id") for df in (t.controls, t.computations, t.visuals, t.explorations)]
    run = running[0].union(running[1]).union(running[2]).union(running[3])
    more = lambda df, key, code: _found(df.groupBy("case", key).count().filter("count > 1"), code, F.col(key))
    both = lambda df, with_, code, how, target="id": _found(df.join(with_, ["case", "id"], how), code, F.col(target))
    number = lambda df, name: df.groupBy("case").agg(F.count(F.lit(1)).alias(name))
    sizes = t.cases.select("case").distinct()
    for df, name in ((t.controls, "controls"), (t.explorations, "explorations"), (t.visuals, "visuals"), (t.computations, "computations")):
        sizes = sizes.join(number(df, name), "case", "left")
    sizes = sizes.fillna(0, ["controls", "explorations", "visuals", "computations"])
    none = F.lit(None)

    declared, named = ids_of(t.reads), ids_of(t.used)
    apart = declared.join(named, ["case", "id", "ref"], "left_anti").union(named.join(declared, ["case", "id", "ref"], "left_anti"))
    own = t.computations.select("case", "id")
    types = t.outputs.join(t.computations.select("case", "id", F.col("type").alias("made")), ["case", "id"]).join(t.variables.select("case", F.col("id").alias("ref"), "type"), ["case", "ref"])
    parts = [
        more(t.variables, "id", "DUPLICATE_VARIABLE"), more(run, "id", "DUPLICATE_ID"), more(t.controls.filter("variable is not null"), "variable", "DUPLICATE_CONTROL"),
        _found(sizes.filter(F.col("controls") < LEAST_CONTROLS), "FEW_CONTROLS", none), _found(sizes.filter(F.col("explorations") != EXPLORATIONS), "NOT_TWO_EXPLORATIONS", none),
        _found(sizes.filter("visuals = 0"), "NO_VISUALS", none), _found(sizes.filter("computations = 0"), "NO_COMPUTATIONS", none),
        _found(apart, "READS_DIFFER", F.col("id")), both(own, ids(t.outputs), "NO_OUTPUT", "left_anti"),
        _found(types.filter(~F.col("made").eqNullSafe(F.col("type"))), "OUTPUT_TYPE", F.col("ref")), more(t.outputs, "ref", "OUTPUT_TWICE"),
        both(computed, initial, "OUTPUT_IS_INITIAL", "left_semi"), both(computed.union(initial), variables, "UNKNOWN_STATE", "left_anti"),
        both(variables, computed.union(initial), "WITHOUT_VALUE", "left_anti"), both(ids(t.reads, "ref"), computed.union(initial), "UNRESOLVED_READ", "left_anti"),
        _found(t.controls.select("case", F.col("variable").alias("id"), "first").join(t.initial.select("case", "id", "value"), ["case", "id"], "left").filter(~_same_json(F.col("first"), F.col("value"))), "DEFAULT_DIFFERS", F.col("id")),
        _found(t.explorations.filter(~F.coalesce("complete", F.lit(False))), "INCOMPLETE_EXPLORATION", F.col("id")), both(ids(t.data, "ref"), variables, "UNKNOWN_DATA", "left_anti"),
        both(ids(t.effects, "ref"), variables.union(ids(t.computations)).union(ids(t.visuals)), "UNKNOWN_EFFECT", "left_anti"),
        order_findings(t), effect_findings(t),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def ids_of(refs: DataFrame) -> DataFrame:
    return refs.select("case", "id", "ref").distinct()


def _same_json(a: Column, b: Column) -> Column:
    text = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(text(a) == text(b), F.lit(False))


def _sources(t: Manifest) -> DataFrame:
    """(case, id, before): computations and those whose outputs they read, initial values aside."""
    made = t.outputs.join(t.initial.select("case", F.col("id").alias("ref")), ["case", "ref"], "left_anti").select("case", "ref", F.col("id").alias("before"))
    return t.reads.select("case", "id", "ref").join(made, ["case", "ref"]).select("case", "id", "before").distinct()


def computation_rounds(t: Manifest) -> DataFrame:
    """(case, id, level): the round in which all that a computation reads is there; null on a circle or behind one."""
    told = case_levels(_sources(t).select("case", F.col("before").alias("a"), F.col("id").alias("b"))).select("case", F.col("node").alias("id"), "level", F.lit(True).alias("waits"))
    return t.computations.select("case", "id").distinct().join(told, ["case", "id"], "left").select("case", "id", F.when(F.col("waits").isNull(), 0).otherwise(F.col("level")).alias("level"))


def case_levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``levels`` of edges (case, a, b) within cases: (case, node, level). A task takes whole cases; those with more than ``most`` edges are peeled all at once."""
    key = lambda c: F.struct("case", F.col(c).alias("id"))
    large = lambda df: levels(df.select(key("a").alias("a"), key("b").alias("b"))).select("node.case", F.col("node.id").alias("node"), "level")
    kinds = dict(edges.dtypes)
    edges = edges.filter("case is not null and a is not null and b is not null")
    if kinds["case"] not in ("int", "bigint") or kinds["a"] != "string" or kinds["b"] != "string":
        return large(edges)
    with Rounds(edges.sparkSession) as rounds:
        edges = rounds.result(edges)
    if (cases := split_by_size(edges, most)) is None:
        return by_case(edges, peeled, f"case {kinds['case']}, node string, level bigint")
    return by_case(edges.join(cases, "case", "left_anti"), peeled, f"case {kinds['case']}, node string, level bigint").unionByName(large(edges.join(cases, "case", "left_semi")))


def order_findings(t: Manifest) -> DataFrame:
    """CIRCLE, and OUT_OF_ORDER for a computation that stands after one of a later round."""
    at = t.computations.select("case", "id", "place").join(computation_rounds(t), ["case", "id"])
    before = F.max("level").over(W.partitionBy("case").orderBy("place", "id").rowsBetween(W.unboundedPreceding, -1))
    late = at.filter("level is not null").withColumn("before", before).filter("before > level")
    return _found(at.filter("level is null"), "CIRCLE", F.col("id")).unionByName(_found(late, "OUT_OF_ORDER", F.col("id")))


def effect_findings(t: Manifest) -> DataFrame:
    """DEAD_CONTROL and EFFECT_NOT_REACHED, by the bitmaps of what each control's variable leads to: outputs, computations, and visuals by their data."""
    edges = [t.reads.select("case", F.col("ref").alias("a"), F.col("id").alias("b")), t.outputs.select("case", F.col("id").alias("a"), F.col("ref").alias("b")), t.data.select("case", F.col("ref").alias("a"), F.col("id").alias("b"))]
    node = lambda df, c: df.select("case", F.col(c).alias("node")).distinct()
    known = node(t.variables, "id").union(node(t.computations, "id")).union(node(t.visuals, "id"))
    wanted = t.effects.select("case", "id", F.col("ref").alias("node")).distinct().join(known.distinct(), ["case", "node"], "left_semi").join(t.controls, ["case", "id"], "left_semi")
    outputs, seen = node(t.outputs, "ref"), node(t.visuals.join(t.data, ["case", "id"], "left_semi"), "id")
    with Rounds(t.cases.sparkSession) as rounds:
        bits = rounds.keep(numbered(outputs.union(seen).union(wanted.select("case", "node"))))
        leads = downstream(edges[0].union(edges[1]).union(edges[2]), bits)
        own = t.controls.select("case", "id", F.col("variable").alias("node")).join(leads, ["case", "node"])
        mask = lambda df, name: df.join(bits, ["case", "node"]).groupBy("case", "word").agg(F.bit_or("bits").alias(name))
        met = own.join(mask(outputs, "computed"), ["case", "word"], "left").join(mask(seen, "seen"), ["case", "word"], "left")
        meets = lambda c: F.bool_or(F.coalesce(F.col("bits").bitwiseAND(F.col(c)) != 0, F.lit(False))).alias(c)
        met = met.groupBy("case", "id").agg(meets("computed"), meets("seen"))
        alive = met.filter("computed and seen")
        dead = _found(t.controls.select("case", "id").distinct().join(alive, ["case", "id"], "left_anti"), "DEAD_CONTROL", F.col("id"))
        asked = wanted.join(bits, ["case", "node"])
        have = own.select("case", "id", "word", F.col("bits").alias("have"))
        missed = asked.join(have, ["case", "id", "word"], "left").groupBy("case", "id", "node").agg(F.bool_or(F.coalesce(F.col("bits").bitwiseAND(F.col("have")) != 0, F.lit(False))).alias("reached"))
        return rounds.result(dead.unionByName(_found(missed.filter("not reached"), "EFFECT_NOT_REACHED", F.col("node"))))


def manifests(t: Manifest) -> DataFrame:
    """(case, json): each manifest as one document with its controls, computations in the order of their rounds, outputs, visuals and initial values; a lesson's parts are a bounded group."""
    lists = lambda df, name: df.groupBy("case", "id").agg(F.array_sort(F.collect_set("ref")).alias(name))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    placed = t.computations.join(computation_rounds(t), ["case", "id"], "left").join(lists(t.reads, "reads"), ["case", "id"], "left").join(lists(t.outputs, "outputs"), ["case", "id"], "left")
    rows = placed.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("level", "place", "id", "type", empty("reads"), empty("outputs")))).alias("c"))
    computations = rows.select("case", F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), c["reads"].alias("reads"), c["outputs"].alias("outputs"))).alias("computations"))
    controls = t.controls.join(lists(t.effects, "effects"), ["case", "id"], "left").groupBy("case").agg(F.array_sort(F.collect_list(F.struct("id", "variable", "first", empty("effects")))).alias("controls"))
    visuals = t.visuals.join(lists(t.data, "data"), ["case", "id"], "left").groupBy("case").agg(F.array_sort(F.collect_list(F.struct("id", empty("data")))).alias("visuals"))
    outputs = t.outputs.groupBy("case").agg(F.array_sort(F.collect_set("ref")).alias("outputs"))
    initial = t.initial.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("initial"))
    out = t.cases.select("case").distinct()
    for part in (controls, computations, outputs, visuals, initial):
        out = out.join(part, "case", "left")
    return out.select("case", F.to_json(F.struct("controls", "computations", "outputs", "visuals", "initial")).alias("json"))
