"""Hard negatives against brute force, and what the tree leaves out."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import negatives
from corpusflow.llm.negatives import OP12_SQL, Search, grow, hard_negatives, inner, op12_split_point_tree

from ..conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], is_anchor) -> set[tuple]:
    valid = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        valid[i, v, (label + 1) % 10 if i % 7 == 0 else label] = True
    out = set()
    for anchor in valid:
        if not is_anchor(anchor[0]):
            continue
        scored = [(-sum(a * b for a, b in zip(anchor[1], r[1], strict=True)), r[0], r[2]) for r in valid if r != anchor and len(r[1]) == len(anchor[1])]
        scored.sort()
        for p, i, _ in [x for x in scored if x[2] == anchor[2]][:5]:
            found = [x for x in scored if x[2] != anchor[2] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out |= {(anchor[0], i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(found, 1)}
    return out


def told(frame) -> set[tuple]:
    rows = [tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def clusters(seed: int, n: int, dim: int = 6, labels: int = 4) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((5, dim))
    return [(i, (centres[draw.integers(5)] + 0.4 * draw.standard_normal(dim)).tolist(), int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("seed", "per_block"), [(1, 8192), (2, 60)])
def test_negatives_equal_brute_force(spark, seed, per_block):
    rows = clusters(seed, 500)
    # a third of the rows are copies of two vectors, one of them under several labels
    rows += [(600 + i, [1.0, 0.5, 0.0, 0.25, -0.5, 0.125], 1 + (i % 8 == 0)) for i in range(150)] + [(800 + i, [1.0, 0.25, 0.0, 0.25, -0.5, 0.125], 2) for i in range(60)]
    rows += [(900, None, 1), (910, [0.0] * 6, 1), (920, [1.0] * 6, None), (930, [float("nan")] * 6, 1), (940, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (950, [], 1), (None, [1.0] * 6, 1)]
    rows += [(960, [1.0, 2.0], 1), (961, [1.0, 1.5], 1), (962, [0.5, 0.75], 3), (10, rows[10][1], rows[10][2]), (970, [float("inf")] * 6, 1), (-30, [0.5] * 6, -1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("cell", "block", "query", "point", "v", "dim", "low", "high", "score", "rank")})
    got = told(hard_negatives(frame, F.col("vec_id") % 10 == 0, per_block=per_block))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_query_equals_sql_and_brute_force(spark):
    got = told(op12_split_point_tree(spark, SMALL))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == set(duck.sql(f"SELECT {names} FROM ({OP12_SQL})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == brute(rows, lambda i: i % 100 == 0) and got


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(clusters(1, 9), SCHEMA), F.col("vec_id") > 100).count() == 0
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("same", [True, False])
def test_search_equals_a_scan(monkeypatch, seed, same):
    monkeypatch.setattr(negatives, "LEAF", 6)
    monkeypatch.setattr(negatives, "HELD", 10)
    draw = np.random.default_rng(seed)
    x = np.floor(256 * (np.repeat(draw.standard_normal((8, 5)) * 3, 60, axis=0) + 0.1 * draw.standard_normal((480, 5))))
    labels, ids = draw.integers(0, 3, 480), draw.permutation(480)
    low = draw.integers(-500_000, 1_500_000, (40, 3))
    high = low + draw.integers(-1000, 400_000, (40, 3))
    visited = []
    search = Search(x, labels, ids, same, 4)
    leaf = search._leaf
    search._leaf = lambda rows, who: (visited.append(len(rows) * len(who)), leaf(rows, who))[1]
    q, w, p, s = search(x[:40], labels[:40], low, high)
    got = defaultdict(list)
    for a, b, c, d in zip(q.tolist(), w.tolist(), p.tolist(), s.tolist(), strict=True):
        got[a, b].append((-d, int(ids[c])))
    scores = inner(x[:40], x)
    for a in range(40):
        for b in range(3):
            fits = (scores[a] >= low[a, b]) & (scores[a] <= high[a, b]) & ((labels == labels[a]) == same)
            assert sorted(got[a, b]) == sorted(zip((-scores[a][fits]).tolist(), ids[fits].tolist(), strict=True))[:4]
    # clusters that no window reaches are never multiplied
    assert sum(visited) < 0.75 * 40 * 480


def test_tree_holds_every_row_once(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 5)
    x = np.floor(np.random.default_rng(1).standard_normal((700, 3)) * 4)  # with many equal rows

    def leaves(node):
        return [node.rows] if not node.children else [r for c in node.children for r in leaves(c)]

    assert sorted(np.concatenate(leaves(grow(x, np.arange(700)))).tolist()) == list(range(700))


def test_inner_products_are_exact():
    big = np.array([[2.0**40, 3.0], [1.0, -(2.0**60)]])
    assert inner(big, big).tolist() == [[2**63 - 1, 2**40 - 3 * 2**60], [2**40 - 3 * 2**60, 2**63 - 1]]
