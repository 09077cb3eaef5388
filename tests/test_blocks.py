"""Equation numbers in their turn and figure regions against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.blocks import figure_items, numbered_equations, taken_in_order
from corpusflow.operators.layout import prose_columns


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numbers_take_in_turn(spark, seed):
    draw = random.Random(seed)
    pairs = {(p, f"n{n:02d}", f"e{e:02d}") for p in range(6) for n in range(25) for e in draw.sample(range(20), draw.choice([1, 1, 2, 3]))}
    want = set()
    for p in range(6):
        taken = set()
        for n in sorted({x[1] for x in pairs if x[0] == p}):
            left = {e for q, m, e in pairs if (q, m) == (p, n)} - taken
            if len(left) == 1:
                taken |= left
                want.add((p, n, *left))
    got = taken_in_order(spark.createDataFrame(sorted(pairs), "page int, number string, expression string"), "page")
    assert {tuple(r) for r in got.collect()} == want and any((p, n, e) in want and any(q == p and m < n and f == e for q, m, f in pairs) for p, n, e in want)


def test_a_later_number_gets_what_is_left(spark):
    rows = [("a", "(1)", 50.0, 90.0), ("b", "y = 1", 10.0, 91.0), ("c", "z = 2", 10.0, 94.0), ("d", "(2)", 50.0, 95.0), ("e", "(3)", 50.0, 93.0)]
    blocks = spark.createDataFrame([(1, k, t, x, y - 10, x + 20, y) for k, t, x, y in rows], "page int, key string, text string, x0 double, y0 double, x1 double, y1 double")
    # (1) has b and c within reach and takes neither, (2) and (3) both too; without c, (1) takes b and leaves nothing
    assert numbered_equations(blocks, "page", "key").collect() == []
    assert [tuple(r) for r in numbered_equations(blocks.filter("key != 'c'"), "page", "key").collect()] == [(1, "a", "b")]
    assert numbered_equations(blocks.limit(0), "page", "key").count() == 0


def test_figure_items(spark):
    draw = random.Random(4)
    box = lambda: (x := draw.uniform(0, 500), y := draw.uniform(0, 700), x + draw.uniform(0, 200), y + draw.uniform(0, 150))
    captions = [(p, f"c{i}", *box()) for p in (1, 2) for i in range(12)]
    items = [(p, f"i{i:03d}", draw.choice(["label", "image"]), *box()) for p in (1, 2, 3) for i in range(150)] + [(1, f"j{i}", "label", 100.0, 100.0, 300.0, 200.0) for i in range(9)]
    want = set()
    for p, c, x0, y0, x1, _ in captions:
        for kind in ("label", "image"):
            inside = [i for q, i, k, a, b, d, e in sorted(items) if q == p and k == kind and max(a, x0) < min(d, x1) and max(b, max(0, y0 - 280)) < min(e, y0)]
            want |= {(p, c, kind, i) for i in inside[:10]}
    schema = "x0 double, y0 double, x1 double, y1 double"
    got = figure_items(spark.createDataFrame(captions, f"page int, key string, {schema}"), spark.createDataFrame(items, f"page int, item string, kind string, {schema}"), "page", "key", "item", 800.0, most=10)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 100


def test_boxes_of_figures_are_shuffled_once(spark):
    """Once by page, not once for each square of a grid, and no pair is."""
    box = "page int, x0 double, y0 double, x1 double, y1 double"
    captions, items = spark.createDataFrame([(1, 0.0, 500.0, 400.0, 510.0)], box).withColumn("key", F.lit("c")), spark.createDataFrame([(1, 10.0 * i, 400.0, 10.0 * i + 5, 420.0) for i in range(9)], box)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = figure_items(captions, items.withColumns({"item": F.col("x0").cast("string"), "kind": F.lit("label")}), "page", "key", "item", 800.0)
        counts = found.groupBy("page", "key", "kind").agg(F.count("item").alias("n"))
        assert counts.first()["n"] == 9
        plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan


def test_prose_makes_columns_and_formulas_do_not(spark):
    lines = [(1, "words of prose here", 2.0, 53.0), (1, "words of prose there", 49.0, 98.0), (2, "x = y + 1", 2.0, 40.0), (2, "words of prose there", 55.0, 98.0)]
    lines += [(3, "words of prose here", 2.0, 54.5), (3, "words of prose there", 46.5, 98.0), (4, None, 2.0, 40.0)]
    lines += [(5, "left side of prose", 2.0, 40.0), (5, "right side of prose", 60.0, 98.0), *[(5, "prose across the page", 2.0, 98.0)] * 2]
    df = spark.createDataFrame(lines, "page int, text string, x0 double, x1 double")
    got = {r["page"]: tuple(r)[1:] for r in prose_columns(df, "page", F.col("text"), F.col("x0"), F.col("x1"), F.lit(100.0)).collect()}
    assert got == {1: (1, 1, 0, True), 2: (0, 1, 0, False), 3: (0, 1, 1, False), 4: (0, 0, 0, False), 5: (1, 1, 2, False)}
