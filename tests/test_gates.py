"""The grounding and coverage gates: a row that breaks each rule, bitmaps of descendants against plain walks, requests in a focus."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusflow.operators import coverage, grounding
from corpusflow.operators.coverage import Coverage, coverage_findings, downstream, editable_requests, numbered
from corpusflow.operators.grounding import Grounding, claim_lineage, grounding_findings

GROUNDING = {
    "cases": ("case int", [(1,)]),
    "claims": ("case int, claim_id string, claim string", [(1, "a", "A holds"), (1, "b", "B holds"), (1, "empty", ""), (1, "none", None)]),
    "records": ("case int, record int, claim_id string, claim string, class string, status string", [(1, 1, "a", "A holds", "SOURCE_GROUNDED", "SUPPORTED"), (1, 2, "b", "B holds", "DERIVED", "SUPPORTED")]),
    "record_refs": ("case int, record int, kind string, ref string", [(1, 1, "evidence", "E1"), (1, 2, "computation", "c1")]),
    "objects": ("case int, id string, class string", [(1, "a", "SOURCE_GROUNDED"), (1, "x", "SOURCE_GROUNDED")]),
    "object_refs": ("case int, id string, ref string", [(1, "a", "E1"), (1, "x", "E1")]),
    "known": ("case int, kind string, ref string", [(1, "evidence", "E1"), (1, "evidence", "E2"), (1, "computation", "c1")]),
    "classes": ("case int, class string", [(1, "SOURCE_GROUNDED"), (1, "DERIVED")]),
    "provenance": ("case int, ref string", [(1, "E1")]),
}


def tables(spark, kind, base: dict, **changed):
    return kind(**{k: spark.createDataFrame(changed.get(k, rows), schema) for k, (schema, rows) in base.items()})


def broken(spark, kind, base: dict, rules: list[tuple]):
    """One case for each of ``rules`` (table, row that goes, rows that come): all are judged in one run."""
    changed = {k: [] for k in base}
    for case, (table, old, new, _) in enumerate(rules):
        for k, (_, rows) in base.items():
            changed[k] += [(case, *r[1:]) for r in ([x for x in rows if x != old] + new if k == table else rows)]
    return tables(spark, kind, base, **changed)


def by_case(frame, columns: list[str], n: int) -> list[set]:
    out = [set() for _ in range(n)]
    for r in frame.collect():
        out[r["case"]].add(tuple(r[c] for c in columns))
    return out


GROUNDING_RULES = [
    ("claims", (1, "a", "A holds"), [(1, "a", "A held")], {("CLAIM_UNCLASSIFIED", "a", "FAIL")}),
    ("claims", None, [(1, "z", "more")], {("CLAIM_UNCLASSIFIED", "z", "FAIL")}),
    ("records", None, [(1, 3, "b", "B holds", "DERIVED", "SUPPORTED")], {("DUPLICATE_CLAIM_ID", None, "FAIL"), ("DERIVED_CLAIM_UNBOUND", "b", "FAIL")}),
    ("classes", (1, "DERIVED"), [], {("KNOWLEDGE_CLASS_UNDECLARED", "b", "FAIL")}),
    ("record_refs", None, [(1, 2, "evidence", "E404")], {("EVIDENCE_REFERENCE_INVALID", "b", "FAIL")}),
    ("record_refs", None, [(1, 2, "computation", "c404")], {("COMPUTATION_REFERENCE_INVALID", "b", "FAIL")}),
    ("record_refs", (1, 1, "evidence", "E1"), [], {("SOURCE_CLAIM_UNGROUNDED", "a", "FAIL"), ("EVIDENCE_LINEAGE_MISMATCH", "a", "FAIL")}),
    ("record_refs", (1, 2, "computation", "c1"), [], {("DERIVED_CLAIM_UNBOUND", "b", "FAIL")}),
    ("records", (1, 2, "b", "B holds", "DERIVED", "SUPPORTED"), [(1, 2, "b", "B holds", "DERIVED", "UNSUPPORTED")], {("GROUNDING_UNSUPPORTED", "b", "FAIL")}),
    ("records", (1, 2, "b", "B holds", "DERIVED", "SUPPORTED"), [(1, 2, "b", "B holds", "DERIVED", "PARTIAL")], {("GROUNDING_PARTIAL", "b", "WARN")}),
    ("objects", None, [(1, "b", "SOURCE_GROUNDED")], {("KNOWLEDGE_CLASS_MISMATCH", "b", "FAIL"), ("SOURCE_OBJECT_UNGROUNDED", "b", "FAIL")}),
    ("object_refs", None, [(1, "a", "E2")], {("EVIDENCE_LINEAGE_MISMATCH", "a", "FAIL")}),
    ("object_refs", None, [(1, "x", "E404")], {("EVIDENCE_REFERENCE_INVALID", "x", "FAIL")}),
    ("object_refs", (1, "x", "E1"), [], {("SOURCE_OBJECT_UNGROUNDED", "x", "FAIL")}),
    ("provenance", None, [(1, "E404")], {("PROVENANCE_INVALID", "science.provenance", "FAIL")}),
    ("provenance", (1, "E1"), [], {("PROVENANCE_MISSING", "science.provenance", "FAIL")}),
    ("cases", None, [], set()),
]


def test_each_grounding_rule(spark):
    got = grounding_findings(broken(spark, Grounding, GROUNDING, GROUNDING_RULES))
    assert by_case(got, ["code", "target", "status"], len(GROUNDING_RULES)) == [want for *_, want in GROUNDING_RULES]


def test_lineage_to_the_end_of_a_circle(spark):
    t = tables(spark, Grounding, GROUNDING)
    edges = [(1, "computation", "c1", "computation", "c2"), (1, "computation", "c2", "computation", "c1"), (1, "computation", "c2", "object", "x"), (1, "object", "x", "evidence", "E1"), (1, "object", "x", "evidence", "E2"), (2, "computation", "c1", "evidence", "E9")]
    got = claim_lineage(t, spark.createDataFrame(edges, "case int, kind string, id string, to_kind string, to string"))
    assert {tuple(r) for r in got.collect()} == {(1, "b", "E1"), (1, "b", "E2")}


def test_lineage_of_whole_cases_makes_no_rounds(spark, monkeypatch):
    """Cases that a task takes whole are not joined round by round; large ones are, and give the same."""
    draw = random.Random(8)
    records = [(c, r, f"cl{r % 7}", "", draw.choice(["DERIVED", "DERIVED", "PEDAGOGICAL"]), "SUPPORTED") for c in (1, 2, 3) for r in range(9)]
    refs = [(c, r, draw.choice(["evidence", "computation"]), f"x{draw.randrange(12)}") for c in (1, 2, 3) for r in range(9) for _ in range(2)]
    edges = [(c, "computation", f"x{draw.randrange(12)}", draw.choice(["evidence", "computation"]), f"x{draw.randrange(12)}") for c in (1, 2, 3) for _ in range(5 * c)]
    want = set()
    for c, r, claim, _, kind, _ in records:
        todo, seen = [x[2:] for x in refs if x[:2] == (c, r)] if kind == "DERIVED" else [], set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [e[3:] for e in edges if e[:3] == (c, *x)]
        want |= {(c, claim, ref) for k, ref in seen if k == "evidence"}
    t = tables(spark, Grounding, GROUNDING, records=records, record_refs=refs)
    rows = spark.createDataFrame(edges, "case int, kind string, id string, to_kind string, to string")
    assert {tuple(r) for r in claim_lineage(t, rows, most=6).collect()} == want
    monkeypatch.setattr(grounding, "reachable", None)
    assert {tuple(r) for r in claim_lineage(t, rows).collect()} == want and want


def test_bitmaps_of_whole_cases_make_no_rounds(spark, monkeypatch):
    draw = random.Random(6)
    edges = spark.createDataFrame([(c, f"n{draw.randrange(80)}", f"n{draw.randrange(80)}") for c in range(6) for _ in range(20 * c + 5)], "case int, a string, b string")
    bits = numbered(spark.createDataFrame([(c, f"n{i}") for c in range(6) for i in range(80)], "case int, node string"))
    rows = lambda df: {(r["case"], r["node"], r["word"], r["bits"]) for r in df.filter("bits != 0").collect()}
    want = rows(coverage._by_rounds(edges, bits))
    assert rows(downstream(edges, bits, most=40)) == want
    monkeypatch.setattr(coverage, "_by_rounds", None)
    assert rows(downstream(edges, bits)) == want and want


def test_bitmaps_equal_walks(spark):
    draw = random.Random(5)
    edges = [(c, f"n{draw.randrange(90)}", f"n{draw.randrange(90)}") for c in (1, 2) for _ in range(110)] + [(1, "hub", f"n{i}") for i in range(90)]
    marks = [(1, f"n{i}") for i in range(90)] + [(2, f"n{i}") for i in range(0, 90, 7)] + [(2, "alone")]
    bits = numbered(spark.createDataFrame(marks, "case int, node string"))
    names = {(r["case"], r["word"], (r["bits"] % 2**64).bit_length() - 1): r["node"] for r in bits.collect()}
    assert len(names) == len(marks)
    got = defaultdict(set)
    for r in downstream(spark.createDataFrame(edges, "case int, a string, b string"), bits).collect():
        got[r["case"], r["node"]] |= {names[r["case"], r["word"], k] for k in range(64) if r["bits"] % 2**64 >> k & 1}
    want = defaultdict(set)
    for c in (1, 2):
        for s in {x for e in edges if e[0] == c for x in e[1:]} | {n for k, n in marks if k == c}:
            todo, seen = [s], set()
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += [b for k, a, b in edges if k == c and a == n]
            if reached := seen & {n for k, n in marks if k == c}:
                want[c, s] = reached
    assert got == want


def test_requests(spark):
    rows = [("Show editable Q, k and V inputs", ["q", "k", "v"]), ("editable alpha values; Editable W matrices", ["alpha", "w"]), ("editable, nothing", []), (None, None), ("editable x_1,y and z things", [])]
    got = spark.createDataFrame([(f,) for f, _ in rows], "f string").select(editable_requests(F.col("f"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


COVERAGE = {
    "cases": ("case int", [(1,)]),
    "maps": ("case int, focus string, wanted string", [(1, "editable X inputs", "editable X inputs")]),
    "refs": ("case int, field string, ref string", [(1, "learning_objective", "l"), (1, "mechanism", "m"), (1, "control", "k"), (1, "computation", "c2"), (1, "visual", "w"), (1, "exploration", "e")]),
    "valid": ("case int, field string, ref string", [(1, "learning_objective", "l"), (1, "mechanism", "m"), (1, "control", "k"), (1, "computation", "c1"), (1, "computation", "c2"), (1, "visual", "w"), (1, "exploration", "e")]),
    "variables": ("case int, id string, symbol string", [(1, "x", "X"), (1, "y", "Y"), (1, "z", "Z")]),
    "controls": ("case int, id string, variable string", [(1, "k", "x")]),
    "effects": ("case int, id string, ref string", [(1, "k", "z")]),
    "inputs": ("case int, id string, ref string", [(1, "c1", "x"), (1, "c2", "y")]),
    "outputs": ("case int, id string, ref string", [(1, "c1", "y"), (1, "c2", "z")]),
    "data": ("case int, id string, ref string", [(1, "w", "z")]),
    "involved": ("case int, id string, ref string", [(1, "m", "y")]),
    "setups": ("case int, id string, ref string", [(1, "e", "k")]),
}


COVERAGE_RULES = [
    ("cases", None, [], set()),
    ("maps", COVERAGE["maps"][1][0], [], {("MISSING_MAP", None)}),
    ("maps", COVERAGE["maps"][1][0], [(1, "other", "editable X inputs")], {("FOCUS_CHANGED", "focus")}),
    ("maps", COVERAGE["maps"][1][0], [(1, "editable x and q inputs", "editable x and q inputs")], {("EDITABLE_WITHOUT_CONTROL", "q")}),
    ("refs", (1, "learning_objective", "l"), [], {("INVALID_REFS", "learning_objective")}),
    ("refs", None, [(1, "visual", "w")], {("INVALID_REFS", "visual")}),
    ("refs", None, [(1, "control", "k9")], {("INVALID_REFS", "control")}),
    ("inputs", (1, "c2", "y"), [(1, "c2", "q")], {("CONTROL_UNUSED", "k"), ("CONTROL_WITHOUT_EFFECT", "k"), ("MECHANISM_DISCONNECTED", "m")}),
    ("effects", None, [(1, "k", "q")], {("CONTROL_WITHOUT_EFFECT", "k")}),
    ("data", (1, "w", "z"), [(1, "w", "q")], {("CONTROL_WITHOUT_EFFECT", "k"), ("VISUAL_DISCONNECTED", "w")}),
    ("involved", (1, "m", "y"), [(1, "m", "q")], {("MECHANISM_DISCONNECTED", "m")}),
    ("setups", (1, "e", "k"), [(1, "e", "q")], {("EXPLORATION_IDLE", "e")}),
]


def test_each_coverage_rule(spark):
    got = coverage_findings(broken(spark, Coverage, COVERAGE, COVERAGE_RULES))
    assert by_case(got, ["code", "target"], len(COVERAGE_RULES)) == [want for *_, want in COVERAGE_RULES]
