"""Equations against computations: trees as rows, digests against tree equality, and each rule."""

from __future__ import annotations

import itertools

from corpusflow.functions.expressions import parse
from corpusflow.operators.equations import INVALID, Equations, equation_findings, node_rows, shapes
from corpusflow.shared import Rounds

TEXTS = ["x", "2", "2.0", "'2'", "x + y", "y + x", "x + x", "a + b", "-(x)", "x - y * 2", "(x - y) * 2", "sum([x, y, 2])", "sum([x, [y], 2])", "x[0]", "x[1]", "x if y > 2 else 2", "x if y >= 2 else 2", "not (x > 1 and y > 2)", "x**2 + y", "((x) + (y))"]


def test_digests_equal_trees(spark):
    with Rounds(spark) as rounds:
        frame = spark.createDataFrame([(t,) for t in [*TEXTS, "x +", None, "x", "import os"]], "text string")
        nodes = rounds.keep(node_rows(frame))
        assert {r["text"] for r in nodes.filter(f"kind = '{INVALID}'").collect()} == {"x +", "import os"}
        got = {r["text"]: (r["shape"], r["symbols"]) for r in shapes(nodes, rounds).collect()}
    assert set(got) == set(TEXTS)
    bare = lambda n: (n.kind, "" if n.kind == "variable" else n.value, tuple(bare(a) for a in n.args))
    for a, b in itertools.product(TEXTS, TEXTS):
        one, two = parse(a), parse(b)
        assert (got[a] == got[b]) == (one == two)
        assert (got[a][0] == got[b][0]) == (bare(one) == bare(two)), (a, b)
    assert got["x - y * 2"][1] == ["x", "y"]


def test_each_rule(spark):
    variables = [("t", "t", None), ("v", "x", "X"), ("w", "y", ""), ("u", "x", None)]
    #: computation, bindings, equation, its variables, finding
    rules = [
        ("a * b", {"a": "v", "b": "w"}, "t = x * y", "vw", None),
        ("a * b", {"a": "v", "b": "w"}, "X * y", "vw", None),
        ("b * a", {"a": "v", "b": "w"}, "t = x * y", "vw", "EQUATION_DIFFERS"),
        ("x * y", {"x": "w", "y": "v"}, "t = x * y", "v", "EQUATION_DIFFERS"),
        ("a * b", {"a": "v", "b": "w"}, "t = x * y", "v", "SYMBOL_UNMAPPED"),
        ("a * b", {"a": "v", "b": "w"}, "t = x * y", "vwu", "SYMBOL_AMBIGUOUS"),
        ("x * b", {"x": "u", "b": "w"}, "t = x * y", "vwu", None),
        ("y * b", {"y": "v", "b": "w"}, "t = x * y", "vw", "BINDING_AMBIGUOUS"),
        ("a * q", {"a": "v", "b": "w"}, "t = x * y", "vw", "SYMBOL_UNMAPPED"),
        ("a * b", {"a": "v", "b": "w"}, "t = x = y", "vw", "NOTATION_UNSUPPORTED"),
        ("a * b", {"a": "v", "b": "w"}, "x = x * y", "vw", "OUTPUT_SYMBOL_DIFFERS"),
        ("a *", {"a": "v"}, "t = x", "vw", "EXPRESSION_INVALID"),
        ("a >= b", {"a": "v", "b": "w"}, "x >= y", "vw", None),
        ("a", {"a": "v"}, None, "v", "NOTATION_UNSUPPORTED"),
        (None, {"a": "v"}, "x", "v", "EXPRESSION_INVALID"),
    ]
    make = lambda rows, schema: spark.createDataFrame(rows, "case int, " + schema)
    cases = list(enumerate(rules))
    t = Equations(
        computations=make([(i, "c", "expression", r[0]) for i, r in cases] + [(90, "c", "machine", "x")], "id string, kind string, expression string"),
        bindings=make([(i, "c", a, v) for i, r in cases for a, v in r[1].items()], "id string, alias string, variable string"),
        outputs=make([(i, "c", "t") for i, _ in cases], "id string, variable string"),
        links=make([(i, "c", "q") for i, _ in cases] + [(90, "c", "q"), (91, "c", "none"), (0, "c", "none")], "id string, equation string"),
        equations=make([(i, "q", r[2]) for i, r in cases] + [(90, "q", "x"), (92, "loose", "x"), (93, "context", "x")], "equation string, expression string"),
        equation_variables=make([(i, "q", v) for i, r in cases for v in r[3]], "equation string, variable string"),
        variables=make([(i, *v) for i, _ in cases for v in variables], "variable string, source_symbol string, display_symbol string"),
        scope=make([(93, "context", "context_only"), (94, "gone", "context_only"), (92, "loose", "other")], "equation string, scope string"),
    )
    got = {(r["case"], r["code"]) for r in equation_findings(t).collect()}
    want = {(i, r[4]) for i, r in cases if r[4]} | {(90, "LINK_KIND_UNSUPPORTED"), (0, "EQUATION_UNKNOWN"), (92, "EQUATION_UNLINKED"), (94, "SCOPE_UNKNOWN")}
    assert got == want
