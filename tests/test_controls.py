"""Controls: policies, a setting that breaks each rule, shapes of any depth, probes against a plain version of what they promise."""

from __future__ import annotations

import dataclasses
import json
import math

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import controls
from corpusflow.operators.controls import Presets, matrix_probes, preset_findings, probes, under_policy


def one(spark, value, kind, **more):
    types = {"vector": "array<double>", "matrix": "array<array<double>>", "select": "string", "toggle": "boolean"}
    df = spark.createDataFrame([(value,)], f"v {types.get(kind, 'double')}")
    got, fine = under_policy(F.col("v"), kind, more.pop("rule", "clamp"), *(F.lit(more.pop(end, to)).cast("double") for end, to in (("low", 0.0), ("high", 1.0))), **more)
    r = df.select(got.alias("got"), fine.alias("fine")).first()
    return (r["got"], r["fine"])


def test_policies(spark):
    assert one(spark, 2.0, "number") == (1.0, True)
    assert one(spark, 2.0, "number", high=None) == (2.0, True)
    assert one(spark, -3.0, "slider", low=None, rule="reject") == (-3.0, True)
    assert one(spark, 2.0, "number", strict=True) == (None, False)
    assert one(spark, 2.0, "number", rule="warn") == (2.0, True)
    assert one(spark, 2.0, "number", rule="warn", strict=True) == (None, False)
    assert one(spark, 0.5, "number", rule="normalize") == (None, False)
    assert one(spark, None, "number") == (None, False)
    assert one(spark, math.nan, "number") == (None, False)
    assert one(spark, [-1.0, 0.5, 3.0], "vector") == ([0.0, 0.5, 1.0], True)
    assert one(spark, [-1.0, 0.5], "vector", rule="reject") == (None, False)
    assert one(spark, [0.5, None], "vector") == (None, False)
    assert one(spark, [[2.0], [0.5]], "matrix") == ([[1.0], [0.5]], True)
    assert one(spark, [1.0, 3.0], "vector", rule="normalize", distribution=True) == ([0.25, 0.75], True)
    assert one(spark, [3.0, 4.0], "vector", rule="normalize") == ([0.6, 0.8], True)
    assert one(spark, [0.0, 0.0], "vector", rule="normalize") == (None, False)
    assert one(spark, [2.0, -1.0], "vector", rule="normalize", distribution=True) == (None, False)
    assert one(spark, [3.0, -4.0], "vector", rule="normalize") == (None, False)  # below the least entry
    assert one(spark, "a", "select", options=F.array(F.lit("a"), F.lit("b"))) == ("a", True)
    assert one(spark, "c", "select", options=F.array(F.lit("a"), F.lit("b"))) == (None, False)
    assert one(spark, False, "toggle") == (False, True)
    with pytest.raises(ValueError):
        one(spark, 1.0, "number", rule="guess")


#: variable: kind, rule, low, high, options, type, dims
DECLARED = {
    "n": ("number", "reject", 1.0, 9.0, None, "scalar", []),
    "free": ("number", "warn", None, None, None, "scalar", []),
    "s": ("select", "reject", None, None, ['"a"', "2"], "scalar", []),
    "t": ("toggle", "reject", None, None, None, "scalar", []),
    "w": ("vector", "clamp", 0.0, 1.0, None, "vector", ["n"]),
    "m": ("matrix", "clamp", 0.0, 10.0, None, "matrix", ["2", "n"]),
    "d": ("vector", "normalize", None, None, None, "distribution", ["2"]),
    "lost": ("vector", "clamp", None, None, None, "vector", ["nowhere"]),
    "open": ("vector", "normalize", None, None, None, "vector", []),
    "deep": ("matrix", "clamp", None, None, None, "tensor", ["2", "1", "3"]),
}
CASES = [
    ({"n": "3", "w": "[0, 0.5, 1]", "m": "[[1,2,3],[4,5,6]]", "d": "[0.25, 0.75]", "s": ' "a"', "t": "true", "free": "-1e300", "deep": "[[[1,2,3]],[[4,5,6]]]"}, {}),
    ({"w": "[0, 0.5]"}, {}),  # n is 2 at first
    ({"w": "[0, 0.5, 1]"}, {"w": "SHAPE"}),
    ({"w": "0.5"}, {"w": "SHAPE"}),
    ({"n": "true", "w": "[1]"}, {"n": "NOT_NUMERIC", "w": "DIMENSION"}),
    ({"n": "2.5", "w": "[1, 1]"}, {"w": "DIMENSION"}),
    ({"n": "10"}, {"n": "RANGE"}),
    ({"n": "0", "w": "[]"}, {"n": "RANGE", "w": "RAGGED"}),
    ({"w": "[0, 2]"}, {"w": "RANGE"}),
    ({"w": '[0, "1"]'}, {"w": "NOT_NUMERIC"}),
    ({"m": "[[1,2],[3]]"}, {"m": "RAGGED"}),
    ({"m": "[[1,2],3]"}, {"m": "RAGGED"}),
    ({"m": "[[1,2],[]]"}, {"m": "RAGGED"}),
    ({"m": "[[],[]]"}, {"m": "RAGGED"}),
    ({"m": "[[1],[[]]]"}, {"m": "RAGGED"}),
    ({"deep": "[[[1,2,3]],[[4,5]]]"}, {"deep": "RAGGED"}),
    ({"d": "[0.5, 0.6]"}, {"d": "NORMALIZED"}),
    ({"d": "[-0.5, 1.5]"}, {"d": "NORMALIZED"}),
    ({"s": '"b"'}, {"s": "OPTION"}),
    ({"s": "2"}, {}),
    ({"t": "1"}, {"t": "TOGGLE"}),
    ({"n": "null"}, {"n": "NOT_A_VALUE"}),
    ({"n": "{"}, {"n": "NOT_A_VALUE"}),
    ({"n": None}, {"n": "NOT_A_VALUE"}),
    ({"n": '{"a": 1}'}, {"n": "NOT_A_VALUE"}),
    ({"n": "1e999"}, {"n": "NOT_NUMERIC"}),
    ({"lost": "[1]"}, {"lost": "DIMENSION"}),
    ({"nobody": "1"}, {"nobody": "UNCONTROLLED"}),
    ({"bare": "1"}, {"bare": "UNDECLARED"}),
]


def presets(spark, cases, twice=()):
    rows = [(1, p, k, v) for p, (given, _) in enumerate(cases) for k, v in given.items()] + list(twice)
    declared = [(1, k, *v) for k, v in DECLARED.items()]
    return Presets(
        settings=spark.createDataFrame(rows, "case int, preset int, variable string, value string").withColumn("kind", F.lit("more")),
        controls=spark.createDataFrame([(*r[:7],) for r in declared] + [(1, "bare", "number", "clamp", None, None, None)], "case int, variable string, kind string, rule string, low double, high double, options array<string>"),
        variables=spark.createDataFrame([(r[0], r[1], r[7], r[8]) for r in declared], "case int, variable string, type string, dims array<string>"),
        initial=spark.createDataFrame([(1, "n", "2"), (2, "nowhere", "1")], "case int, variable string, value string"),
    )


def found(frame):
    out = {}
    for r in frame.collect():
        assert r["variable"] not in out.setdefault(r["preset"], {})
        out[r["preset"]][r["variable"]] = r["code"]
    return out


def test_each_rule_has_a_setting_that_breaks_it(spark):
    assert found(preset_findings(presets(spark, CASES))) == {p: want for p, (_, want) in enumerate(CASES) if want}


def test_settings_made_twice_and_empty_tables(spark):
    assert found(preset_findings(presets(spark, [({"n": "3"}, {})], [(1, 0, "n", "4")]))) == {0: {"n": "TWICE"}}
    assert preset_findings(presets(spark, [], [])).count() == 0


def test_presets_as_rows_of_arrays(spark, monkeypatch):
    """Presets whose settings come as arrays, one of them in two rows, give what their rows give; however many settings share a value, it is unfolded once."""
    cases = CASES + [({"n": "3"}, {})] * 20
    t = presets(spark, cases, [(1, 0, "n", "4")])
    want = {p: {**w, **({"n": "TWICE"} if p == 0 and "n" in cases[0][0] else {})} for p, (_, w) in enumerate(cases)}
    rows = t.settings.withColumn("half", F.col("preset") == 0).withColumn("half", F.col("half") & (F.col("variable") < "n"))
    arrays = rows.groupBy("case", "preset", "half").agg(F.collect_list(F.struct("variable", "value")).alias("settings")).drop("half")
    unfolded = []
    plain = controls.nodes
    monkeypatch.setattr(controls, "nodes", lambda df, *more: unfolded.append(df.count()) or plain(df, *more))
    of_rows, of_arrays = found(preset_findings(t)), found(preset_findings(dataclasses.replace(t, settings=arrays)))
    assert of_rows == of_arrays and {p: of_rows.get(p, {}) for p in range(1, len(cases))} == {p: w for p, w in want.items() if p}
    assert unfolded == [t.settings.select("value").filter("value is not null").distinct().count()] * 2


def test_canonical_values_bring_their_shape(spark):
    cases = [({"lost": "[1, 2]", "open": "[0.6, 0.8]"}, {}), ({"open": "[0.5, 0.5]"}, {"open": "NORMALIZED"}), ({"open": "[[1]]"}, {"open": "NORMALIZED"}), ({"w": "[0, 1, 1]"}, {"w": "SHAPE"})]
    assert found(preset_findings(presets(spark, cases), canonical=True)) == {p: want for p, (_, want) in enumerate(cases) if want}


def test_a_long_vector_is_rows(spark):
    text = json.dumps([0.25] * 50_000)
    cases = [({"n": "5", "w": text}, {"w": "SHAPE"}), ({"w": text.replace("0.25]", '"x"]')}, {"w": "SHAPE"})]
    assert found(preset_findings(presets(spark, cases))) == {0: {"w": "SHAPE"}, 1: {"w": "SHAPE"}}


def plain_probes(v, low, high, domain, distribution, rule):
    """Probes one by one."""
    n, out = len(v), []
    spots = sorted({0, n // 2, n - 1}) if n else []

    def add(p):
        if p is not None and p != v and p not in out:
            out.append(p)

    if distribution and domain != "positive" and (low is None or low <= 0) and (high is None or high >= 1):
        for i in spots:
            add([float(j == i) for j in range(n)])
    for i in spots:
        for sign in (1, -1):
            x = v[i] + sign * max(1.0 if domain == "integer" else 0.25, abs(v[i]) / 4)
            x = x if low is None else max(x, low)
            x = x if high is None else min(x, high)
            x = {"nonnegative": max(x, 0.0), "probability": max(x, 0.0), "positive": max(x, 1e-6), "unit_interval": min(max(x, 0.0), 1.0), "integer": float(round(x))}.get(domain, x)
            p = list(v)
            if rule == "normalize":
                p[i] = x
                size = sum(p) if distribution else math.sqrt(sum(y * y for y in p))
                add([y / size for y in p] if size > 0 else None)
            elif distribution:
                if n > 1:
                    k = (i + 1) % n
                    gain = max(-v[i], min(x - v[i], v[k]))
                    p[i], p[k] = p[i] + gain, p[k] - gain
                    add(p)
            else:
                p[i] = x
                add(p)
    return out


@pytest.mark.parametrize("domain", ["real", "nonnegative", "positive", "unit_interval", "integer"])
@pytest.mark.parametrize("distribution", [True, False])
@pytest.mark.parametrize("rule", ["clamp", "normalize"])
def test_probes_equal_a_plain_version(spark, domain, distribution, rule):
    vectors = [[], [1.0], [0.0], [0.5, 0.5], [0.0, 0.0], [0.2, 0.3, 0.5], [1.0, 0.0, 0.0, 0.0], [3.0, -8.0, 2.0, 6.0, 1.0], [0.125, 0.375, 0.25, 0.25]]
    bounds = ((None, None), (0.0, 1.0), (0.1, None))
    made = [probes(F.col("v"), *(F.lit(x).cast("double") for x in ends), domain, distribution, rule).alias(f"p{k}") for k, ends in enumerate(bounds)]
    for r in spark.createDataFrame([(v,) for v in vectors], "v array<double>").coalesce(1).select("v", *made).collect():
        for k, ends in enumerate(bounds):
            got, want = r[f"p{k}"], plain_probes(r["v"], *ends, domain, distribution, rule)
            assert len(got) == len(want), (r["v"], ends, got, want)
            assert all(p == pytest.approx(q, abs=1e-12) for p, q in zip(got, want, strict=True))
            if distribution and rule != "normalize":
                assert all(sum(p) in (pytest.approx(sum(r["v"])), 1.0) for p in got)


def test_probes_of_matrices(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "m array<array<double>>")
    got = df.select(matrix_probes(F.col("m"), F.lit(0.0), F.lit(4.0)).alias("p")).first()["p"]
    assert got == [[[1.25, 2.0], [3.0, 4.0]], [[0.75, 2.0], [3.0, 4.0]], [[1.0, 2.0], [3.75, 4.0]], [[1.0, 2.0], [2.25, 4.0]], [[1.0, 2.0], [3.0, 3.0]]]
