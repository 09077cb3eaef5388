"""Manifests: a row that breaks each rule, empty tables, and the documents put together."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from corpusflow.operators.closure import levels
from corpusflow.operators.manifest import Manifest, case_levels, manifest_findings, manifests

from .test_gates import broken, by_case, tables

LESSON = {
    "cases": ("case int", [(1,)]),
    "variables": ("case int, id string, type string", [(1, v, "scalar") for v in "xysz"]),
    "initial": ("case int, id string, value string", [(1, "x", "1"), (1, "y", "[2, 3]")]),
    "controls": ("case int, id string, variable string, first string", [(1, "cx", "x", "1"), (1, "cy", "y", "[2,3]")]),
    "effects": ("case int, id string, ref string", [(1, "cx", "z"), (1, "cy", "view")]),
    "computations": ("case int, id string, place int, type string", [(1, "f", 0, "scalar"), (1, "g", 1, "scalar")]),
    "reads": ("case int, id string, ref string", [(1, "f", "x"), (1, "g", "s"), (1, "g", "y")]),
    "used": ("case int, id string, ref string", [(1, "f", "x"), (1, "g", "s"), (1, "g", "y")]),
    "outputs": ("case int, id string, ref string", [(1, "f", "s"), (1, "g", "z")]),
    "visuals": ("case int, id string", [(1, "view")]),
    "data": ("case int, id string, ref string", [(1, "view", "z")]),
    "explorations": ("case int, id string, complete boolean", [(1, "e1", True), (1, "e2", True)]),
}
RULES = [
    ("cases", None, [], set()),
    ("effects", None, [(1, "cx", "f"), (1, "cx", "x"), (1, None, "z"), (1, "cx", None)], set()),
    ("variables", None, [(1, "x", "scalar")], {("DUPLICATE_VARIABLE", "x")}),
    ("visuals", None, [(1, "f")], {("DUPLICATE_ID", "f")}),
    ("controls", None, [(1, "c3", "x", "1")], {("DUPLICATE_CONTROL", "x")}),
    ("controls", (1, "cx", "x", "1"), [], {("FEW_CONTROLS", None)}),
    ("explorations", (1, "e2", True), [], {("NOT_TWO_EXPLORATIONS", None)}),
    ("visuals", (1, "view"), [], {("NO_VISUALS", None), ("UNKNOWN_EFFECT", "view"), ("DEAD_CONTROL", "cx"), ("DEAD_CONTROL", "cy")}),
    ("used", None, [(1, "g", "x")], {("READS_DIFFER", "g")}),
    ("outputs", (1, "f", "s"), [], {("NO_OUTPUT", "f"), ("WITHOUT_VALUE", "s"), ("UNRESOLVED_READ", "s"), ("DEAD_CONTROL", "cx"), ("EFFECT_NOT_REACHED", "z")}),
    ("variables", (1, "s", "scalar"), [(1, "s", "vector")], {("OUTPUT_TYPE", "s")}),
    ("outputs", None, [(1, "f", "z")], {("OUTPUT_TWICE", "z")}),
    ("initial", None, [(1, "s", "0")], {("OUTPUT_IS_INITIAL", "s")}),
    ("initial", None, [(1, "q", "1")], {("UNKNOWN_STATE", "q")}),
    ("variables", None, [(1, "lone", "scalar")], {("WITHOUT_VALUE", "lone")}),
    ("reads", None, [(1, "g", "nowhere")], {("READS_DIFFER", "g"), ("UNRESOLVED_READ", "nowhere")}),
    ("reads", None, [(1, "f", "z")], {("READS_DIFFER", "f"), ("CIRCLE", "f"), ("CIRCLE", "g")}),
    ("reads", None, [(1, "f", "s")], {("READS_DIFFER", "f"), ("CIRCLE", "f"), ("CIRCLE", "g")}),
    ("computations", (1, "g", 1, "scalar"), [(1, "g", -1, "scalar")], {("OUT_OF_ORDER", "f")}),
    ("controls", (1, "cx", "x", "1"), [(1, "cx", "x", "1.5")], {("DEFAULT_DIFFERS", "x")}),
    ("explorations", (1, "e2", True), [(1, "e2", None)], {("INCOMPLETE_EXPLORATION", "e2")}),
    ("data", None, [(1, "view", "nowhere")], {("UNKNOWN_DATA", "nowhere")}),
    ("effects", None, [(1, "cx", "nowhere")], {("UNKNOWN_EFFECT", "nowhere")}),
    ("effects", None, [(1, "cy", "s")], {("EFFECT_NOT_REACHED", "s")}),
    ("data", (1, "view", "z"), [(1, "view", "s")], {("DEAD_CONTROL", "cy"), ("EFFECT_NOT_REACHED", "view")}),
]


def test_each_rule_of_manifests(spark):
    got = by_case(manifest_findings(broken(spark, Manifest, LESSON, RULES)), ["code", "target"], len(RULES))
    assert got == [want for *_, want in RULES]


def test_a_manifest_of_nothing_and_no_manifest(spark):
    bare = {k: [] for k in LESSON}
    assert manifest_findings(tables(spark, Manifest, LESSON, **bare)).count() == 0
    got = by_case(manifest_findings(tables(spark, Manifest, LESSON, **{**bare, "cases": [(0,)]})), ["code", "target"], 1)
    assert got == [{(code, None) for code in ("FEW_CONTROLS", "NOT_TWO_EXPLORATIONS", "NO_VISUALS", "NO_COMPUTATIONS")}]


def test_documents_hold_computations_in_the_order_of_their_rounds(spark):
    made = tables(spark, Manifest, LESSON, computations=[(1, "g", 0, "scalar"), (1, "f", 1, "scalar")])
    doc = json.loads(manifests(made).first()["json"])
    assert [c["id"] for c in doc["computations"]] == ["f", "g"] and doc["computations"][1]["reads"] == ["s", "y"]
    assert doc["outputs"] == ["s", "z"] and doc["controls"][1] == {"id": "cy", "variable": "y", "first": "[2,3]", "effects": ["view"]} and doc["visuals"] == [{"id": "view", "data": ["z"]}]


def test_levels_of_whole_cases(spark):
    """Peeled in tasks or all at once, with circles; a case above the limit goes the other way."""
    draw = random.Random(2)
    edges = spark.createDataFrame([(c, f"n{a}", f"n{b}") for c in range(6) for a, b in (sorted(draw.sample(range(14), 2)) for _ in range(6 * c + 3))] + [(9, "a", "b"), (9, "b", "a"), (9, "b", "c"), (9, "d", "c")], "case int, a string, b string")
    rows = lambda df: {tuple(r) for r in df.select("case", "node", "level").collect()}
    key = lambda c: F.struct("case", F.col(c).alias("id"))
    want = rows(levels(edges.select(key("a").alias("a"), key("b").alias("b"))).select("node.case", F.col("node.id").alias("node"), "level"))
    assert rows(case_levels(edges)) == want and rows(case_levels(edges, most=15)) == want
