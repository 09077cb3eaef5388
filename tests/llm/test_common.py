"""The shared folder: what operators leave there, and where it may lie."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest

from corpusflow.llm import common
from corpusflow.llm.common import Scratch, running_totals, shared_dir, small_batches, text_buffers
from corpusflow.llm.jaccard import jaccard_components
from corpusflow.llm.line_runs import repeated_runs

from .helpers import docs, text_of


def left(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_results_stay(spark):
    draw = random.Random(1)
    df = docs(spark, {i: "\n".join(text_of(draw, 9) for _ in range(3)) if i % 3 else "one text\nthat is there often" for i in range(12)})
    before = left(spark)
    repeated_runs(df).count()
    jaccard_components(df).count()
    assert sorted(x.rsplit("-", 1)[0] for x in left(spark) - before) == ["classes", "runs"]


def test_tables_go_when_an_operator_fails(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch:
        assert scratch.stage(spark.range(3), "some").count() == 3
        raise ZeroDivisionError
    assert left(spark) == before


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_running_totals(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(draw.randrange(9), i, draw.randrange(5)) for i in range(300)]
    got = running_totals(spark.createDataFrame(rows, "a long, b long, v long"), ["a", "b"], "v", "before").collect()
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b] = total
        total += v
    assert {(r["a"], r["b"]): r["before"] for r in got} == want and common.MAX_SENT > 0


def test_texts_go_to_python_in_small_batches(spark):
    """A caller's own smaller setting holds, and the session has its own again afterwards, whatever happens within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(3000, numPartitions=1)
    sizes = lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches)
    with pytest.raises(ValueError), small_batches(spark, 1000):
        assert {r["n"] for r in rows.mapInArrow(sizes, "n long").collect()} == {1000}
        with small_batches(spark, 5000):
            assert spark.conf.get(name) == "1000"
        raise ValueError
    assert spark.conf.get(name) == before
    assert max(len(buf) for _, buf, _ in text_buffers(pa.array(["x" * 1000] * 2000))) <= 250_000
