"""Closures to their fixpoint against plain walks: deep chains, circles, several parents, hot parents."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from corpusflow.operators.closure import ancestors, hierarchy_findings, levels, reachable
from corpusflow.operators.rules import anchor_ranks, explicit_lookup

SECTIONS = "section string, parent string"


def walk(up: dict) -> set:
    out = set()
    for s in up:
        todo, seen = [s], set()
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [p for p in up.get(a, ()) if p in up]
        out |= {(s, a) for a in seen}
    return out


def told(df):
    return {tuple(r) for r in df.collect()}


def test_a_chain_of_any_depth(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(14)]
    assert ancestors(spark.createDataFrame(rows, SECTIONS)).count() == 105
    rows = [(f"s{i:03d}", f"s{i - 1:03d}" if i else None) for i in range(150)]
    assert ancestors(spark.createDataFrame(rows, SECTIONS)).count() == 150 * 151 // 2


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_and_circles(spark, seed):
    draw = random.Random(seed)
    up = defaultdict(set)
    for i in range(60):
        up[f"s{i}"] |= {f"s{draw.randrange(max(1, i))}"} if i and draw.random() < 0.9 else set()
    for i in range(200, 260):  # a third of the sections lie below one
        up[f"s{i}"].add("s5")
    up["s3"].add("s7")
    up["c0"], up["c1"], up["c2"], up["below"], up["lost"], up["own"] = {"c2"}, {"c0"}, {"c1"}, {"c1"}, {"nowhere"}, {"own"}
    rows = [(s, p) for s, ps in up.items() for p in ps or [None]] + [("s1", next(iter(up["s1"]), None)), (None, "s1")]
    sections = spark.createDataFrame(rows, SECTIONS)
    pairs = ancestors(sections)
    want = walk(up)
    assert told(pairs) == want and pairs.count() == len(want)
    circle = {("SECTION_CYCLE", s) for s in up if any((p, s) in want for p in up[s])}
    assert told(hierarchy_findings(sections, pairs)) == circle | {("SECTION_PARENT_ABSENT", "nowhere")}
    assert {("SECTION_CYCLE", x) for x in ("c0", "c1", "c2", "own")} <= circle and ("SECTION_CYCLE", "below") not in circle
    assert ancestors(sections.limit(0)).count() == 0


def test_lookup_takes_all_sections_below(spark):
    sections = spark.createDataFrame([(f"s{i}", str(i), f"s{i - 1}" if i else None) for i in range(14)], "section string, number string, parent string")
    elements = spark.createDataFrame([(i, f"s{i}", "figure", f"{i}A") for i in range(14)], "element int, section string, kind string, number string")
    references = spark.createDataFrame([(1, "section", "0"), (1, "figure", "3a"), (2, "section", "12"), (2, "section", "99"), (3, "section", "0")], "case int, kind string, number string")
    found, missing = explicit_lookup(references, elements, sections)
    assert told(found) == {(c, "section", "0", i) for c in (1, 3) for i in range(14)} | {(1, "figure", "3a", 3), (2, "section", "12", 12), (2, "section", "12", 13)}
    assert told(missing) == {(2, "section", "99")}


def test_reachable_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 10), (None, 3), (50, 51)], "a int, b int")
    starts = spark.createDataFrame([(0,), (25,), (99,)], "start int")
    assert told(reachable(edges, starts)) == {(0, i) for i in range(31)} | {(25, i) for i in range(10, 31)} | {(99, 99)}
    assert told(reachable(edges, starts, 2)) == {(0, 0), (0, 1), (0, 2), (25, 25), (25, 26), (25, 27), (99, 99)}


def test_levels_at_any_depth_and_below_circles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n0", "n9"), ("x", "y"), ("y", "x"), ("y", "z"), ("r", "z"), ("n0", "n1")]
    got = dict(told(levels(spark.createDataFrame(edges, "a string, b string"))))
    assert got == {f"n{i}": i for i in range(13)} | {"r": 0, "x": None, "y": None, "z": None}


def test_ranks_of_anchors_among_all_that_a_case_names(spark):
    """Counted by patterns of references; plain sets must give the same."""
    draw = random.Random(3)
    tree = [("r0", "Top", None), ("r1", "Other", None)] + [(f"n{i}", f"N{i}", f"r{i % 2}") for i in range(4)] + [(f"c{i}", f"C{i}", f"n{i % 4}") for i in range(12)]
    elements = [(i, f"c{draw.randrange(12)}", draw.choice(["figure", "table"]), str(i % 5), draw.random(), draw.random() < 0.3) for i in range(300)]
    names = [("section", n.upper()) for _, n, _ in tree] + [(k, str(n)) for k in ("figure", "table") for n in range(6)]
    references = [(case, *ref) for case in range(40) for ref in draw.sample(names, draw.randrange(1, 6))]
    got = anchor_ranks(
        spark.createDataFrame(references, "case int, kind string, number string"),
        spark.createDataFrame(elements, "element int, section string, kind string, number string, place double, late boolean"),
        spark.createDataFrame(tree, "section string, number string, parent string"),
    )
    up = {s: p for s, _, p in tree}
    numbers = {s: n.lower() for s, n, _ in tree}

    def above(s):
        return [] if s is None else [numbers[s], *above(up[s])]

    want = set()
    for case in range(40):
        own = sorted({(k, n.lower()) for c, k, n in references if c == case})
        found = {r: [e for e in elements if (r[1] in above(e[1]) if r[0] == "section" else (e[2], e[3]) == r)] for r in own}
        order = sorted({(e[4], e[0]) for es in found.values() for e in es})
        taken = set()
        for r in own:
            if found[r]:
                best = min(found[r], key=lambda e: (e[5], e[4]))
                if best[0] not in taken:
                    taken.add(best[0])
                    want.add((case, *r, best[0], order.index((best[4], best[0])) + 1))
    assert {tuple(r) for r in got.collect()} == want
