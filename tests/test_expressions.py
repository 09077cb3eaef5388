from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.arrays import OPERATIONS, Value, is_valid, scalar, vector
from corpusflow.functions.expressions import Node, column, parse
from corpusflow.operators.programs import iterate, levels, machine, run_program

#: Expression to value; every operation occurs.
CASES = {
    "add(1, 2)": 3.0, "subtract(5, 2)": 3.0, "multiply(2, 3)": 6.0, "divide(1, 4)": 0.25, "power(2, 10)": 1024.0, "negate(2)": -2.0, "abs(-3)": 3.0,
    "sqrt(9)": 3.0, "exp(0)": 1.0, "log(1)": 0.0, "sin(0)": 0.0, "cos(0)": 1.0, "sum([1e16, 1, -1e16])": 1.0, "mean([1, 2, 3])": 2.0, "min([3, 1])": 1.0,
    "max([3, 1])": 3.0, "dot([1, 2], [3, 4])": 11.0, "matmul([[1, 2], [3, 4]], [1, 1])": [3.0, 7.0], "transpose([[1, 2], [3, 4]])": [[1.0, 3.0], [2.0, 4.0]],
    "norm([3, 4])": 5.0, "normalize([3, 4])": [0.6, 0.8], "softmax([10000, 10000])": [0.5, 0.5], "entropy([0.5, 0.5])": math.log(2),
    "cross_entropy([1, 0], [0.5, 0.5])": math.log(2), "xlogx(0)": 0.0, "take([1, 2, 3], 2)": [1.0, 2.0], "approx_equal(1, 1 + 1e-9)": True,
    "[[1, 2], [3, 4]][1][0]": 3.0, "1 if 2 > 1 else 0": 1.0, "not (1 < 2 and 3 == 3) or 1 != 1": False, "+2 ** 3": 8.0, "[1, 2] * 2 + [1, 1]": [3.0, 5.0],
}
REJECTED = ["", "x.y", "f(1)", "add(1)", "1 < 2 < 3", "[x for x in y]", "lambda: 1", "x[1:2]", "x[-1]", "add(1, b=2)", "__import__('os')", "[]", "1" * 5000, "1 +" * 300 + "1", "(" * 40 + "1" + ")" * 40 + "**" + "-" * 40 + "1", "1e301"]
INVALID = ["1 / 0", "log(0)", "sqrt(-1)", "exp(1000)", "power(0, -1)", "[1, 2][5]", "[1, 2] + [1, 2, 3]", "normalize([0, 0])", "entropy([0.5, 0.6])", "take([1], 2)", "take([1, 2], 1.5)", "cross_entropy([0.5, 0.5], [1, 0])", "power(2, 200)"]


def same(a, b):
    return a == b if isinstance(b, bool) else all(map(same, a, b)) and len(a) == len(b) if isinstance(b, list) else math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def test_every_operation_has_a_case():
    assert {n.value for e in CASES for n in _nodes(parse(e)) if n.kind == "call"} == set(OPERATIONS)


def _nodes(n):
    return [n, *(x for a in n.args for x in _nodes(a))]


def test_values(spark):
    got = spark.range(1).select(*(column(e, {}).col.alias(f"c{i}") for i, e in enumerate(CASES))).first()
    for (e, want), value in zip(CASES.items(), got, strict=True):
        assert same(value, want), (e, value)


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(ValueError):
        column(text, {"x": scalar(F.lit(1)), "y": scalar(F.lit(1))})


@pytest.mark.parametrize("d", [{}, {"kind": "sum", "value": None, "args": []}, {"kind": "if", "value": None, "args": []}, {"kind": "call", "value": "eval", "args": []}, {"kind": "index", "value": -1, "args": [{"kind": "variable", "value": "x", "args": []}]}, {"kind": "variable", "value": "a b", "args": []}])
def test_stored_trees_are_checked(d):
    with pytest.raises(ValueError):
        Node.from_dict(d)


def test_invalid_values_are_flagged(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    got = spark.range(1).select(*(is_valid(column(e, {})).alias(f"c{i}") for i, e in enumerate(INVALID))).first()
    assert [e for e, ok in zip(INVALID, got, strict=True) if ok] == []


def test_program_raises_on_an_invalid_step(spark):
    with pytest.raises(Exception, match="not a finite value"):
        run_program(spark.createDataFrame([(0.0,)], "x double"), {"x": scalar(F.col("x"))}, {"y": "log(x)"}).collect()


def test_trees_round_trip():
    for e in CASES:
        assert Node.from_dict(parse(e).to_dict()) == parse(e)
    assert parse("a + b").renamed({"a": "c"}).canonical() == parse("c + b").canonical()
    assert parse("a + f").references() == {"a", "f"}


def test_levels_and_circles():
    assert levels({"a": parse("x"), "b": parse("a + 1"), "c": parse("a + b")}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        levels({"a": parse("b"), "b": parse("a")})


def test_iteration_keeps_history(spark):
    row = spark.range(1).select(iterate({"s": "1"}, {"s": "s * 0.5"}, 4, {}).alias("h")).first()
    assert [r["s"] for r in row["h"]] == [1, 0.5, 0.25, 0.125, 0.0625]


def test_machine_moves_and_ambiguity(spark):
    events = F.array(F.lit("go"), F.lit("stay"), F.lit("stop"))
    moves = [("off", "on", lambda e: e == "go"), ("on", "off", lambda e: e == "stop")]
    assert spark.range(1).select(machine(events, "off", moves)).first()[0] == ["off", "on", "on", "off"]
    with pytest.raises(Exception, match="several moves"):
        spark.range(1).select(machine(events, "off", [*moves, ("off", "off", lambda e: e == "go")])).collect()


def test_unequal_lengths_are_invalid_as_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    assert df.select(is_valid(column("a + b", {"a": vector(F.col("a")), "b": vector(F.col("b"))}))).first()[0] is False
    assert df.select(is_valid(Value("boolean", F.lit(None)))).first()[0] is False
