from __future__ import annotations

import random

import json

from pyspark.sql import functions as F

from corpusflow.functions.jsonx import recovered, strict
from corpusflow.functions.text import caption_kind, element_type, equation_number, format_of, heading_title, noise_heading, reference_keys, tokens
from corpusflow.operators.closure import reachable
from corpusflow.operators.search import confidence, pack_greedily
from corpusflow.sources.files import acquired, cases, traces
from corpusflow.sources.pages import elements_of
from corpusflow.streaming.runlog import event_stream, windowed

from .conftest import SMALL

PAGE = """<html><head><script>var a = "<p>no</p>";</script></head><body><nav><li>menu</li></nav><article><h1>1 Feedback</h1><p>One <b>two</b></p>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td colspan="2">x</td></tr></table><figure><p>inner</p></figure><pre>do it</pre></article><p>outside</p></body></html>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_elements():
    found = elements_of(PAGE)
    assert [(t, c) for _, t, c, _, _ in found] == [("h1", "1 Feedback"), ("p", "One two"), ("table", "a b 1 2"), ("table", "x"), ("figure", "inner"), ("pre", "do it")]
    assert [r for *_, r in found if r is not None] == [True, False]
    assert elements_of("") == [] and elements_of("<p>open") == [(0, "p", "open", None, None)]


def test_text_rules(spark):
    assert one(spark, tokens(F.lit("The Größe of x_1, and 42"))) == ["grösse", "x_1", "42"]
    assert one(spark, caption_kind(F.lit("Fig. 3: A loop"))) == "figure" and one(spark, caption_kind(F.lit("a table"))) is None
    assert one(spark, equation_number(F.lit("y = x (6)"))) == "6" and one(spark, equation_number(F.lit("see (6)"))) is None
    assert one(spark, element_type(F.lit("Algorithm 1: do"))) == "algorithm"
    assert one(spark, heading_title(F.lit("1.2 Stability"))) == "Stability" and one(spark, noise_heading(F.lit("3 References")))
    assert [tuple(k) for k in one(spark, reference_keys(F.lit("see Eq. (6) and fig 2a")))] == [("equation", "6"), ("figure", "2a")]
    assert one(spark, format_of(F.lit("  %PDF-1"))) == "pdf" and one(spark, format_of(F.lit("x"), F.lit("text/html"))) == "html"


def test_json(spark):
    rows = [('{"a": 1}', None), ('{"a": 1, "b": 2}', "unknown_field"), ("{}", "missing_field"), ('{"a": "x"}', "wrong_type"), ('{"a": 1, "a": 2}', "not_json"), ("[1]", "not_an_object"), ("{", "not_json")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r for r in df.select(strict(F.col("t"), {"a": "bigint"})[1].alias("f"), "want").collect() if r["f"] != r["want"]] == []
    damaged = ['```json\n{"a": [1, 2,], "b": "x, }"}\n```', '{"a": 1, "a": 2}', '{"a": NaN}', 'text {"a": 1}', '{"a": 1']
    got = [r[0] and json.loads(r[0]) for r in spark.createDataFrame([(x,) for x in damaged], "t string").select(recovered(F.col("t"))).collect()]
    assert got == [{"a": [1, 2], "b": "x, }"}, None, None, None, None]


def test_packing_skips_and_goes_on(spark):
    sizes = [5, 9, 4, 1]
    got = pack_greedily(spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, r long, s long"), "g", "r", "s", most=2, limit=10)
    assert sorted((r["place"], r["r"]) for r in got.collect()) == [(0, 0), (1, 2)]


def test_packing_equals_the_plain_fold(spark):
    import random

    draw = random.Random(3)
    rows = [(f"g{g}", i, draw.randint(1, 40)) for g in range(3) for i in range(200)]
    want = []
    for g in range(3):
        used, kept = 0, []
        for _, i, s in (r for r in rows if r[0] == f"g{g}"):
            if used + s <= 100 and len(kept) < 12:
                used, kept = used + s, [*kept, i]
        want += [(f"g{g}", i) for i in kept]
    got = pack_greedily(spark.createDataFrame(rows, "g string, r long, s long"), "g", "r", "s", limit=100)
    assert sorted((r["g"], r["r"]) for r in got.collect()) == sorted(want)


def test_reachability_ends_in_circles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    got = reachable(edges, spark.createDataFrame([("a",)], "start string"), 5)
    assert sorted(r["node"] for r in got.collect()) == ["a", "b", "c"]


def test_confidence_in_order(spark):
    table = [((0, 1, 1, 1, 1.0, False), "LOW"), ((1, 0, 0, 0, 0.0, True), "HIGH"), ((0, 0, 0, 0, 0.0, False), "LOW"), ((0, 0, 1, 2, 0.5, True), "HIGH"), ((0, 0, 0, 2, 1.0, False), "HIGH"), ((0, 0, 0, 2, 1.0, True), "AMBIGUOUS")]
    for signals, want in table:
        assert one(spark, confidence(*map(F.lit, signals))) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<html><p>x</p></html>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    assert {r["format"] for r in acquired(spark, str(tmp_path)).collect()} == {"html", "pdf"}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text('{"source_url": "u", "focus": "f", "audience": "a"}')
    (tmp_path / "c/2.json").write_text('{"source_url": "u", "focus": " ", "audience": "a"}')
    assert sorted((r["fault"] or "") for r in cases(spark, f"{tmp_path}/c").collect()) == ["", "blank"]
    (tmp_path / "t.jsonl").write_text('{"elapsed_seconds": 1.5, "stage": "s", "action": "a", "result": "r"}\n')
    assert traces(spark, str(tmp_path / "t.jsonl")).first()["stage"] == "s"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = windowed(event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    want = windowed(events).groupBy("event_type").agg(F.sum("n")).collect()
    assert sorted(map(tuple, spark.table("windows").groupBy("event_type").agg(F.sum("n")).collect())) == sorted(map(tuple, want))


def test_eight_digits(spark):
    from corpusflow.functions.text import eight_digits

    draw = random.Random(3)
    values = [0.0, -0.0, 1.0, 100.0, 12345678.0, 123456789.0, 99999999.6, 0.0001, 0.00009999, 1e-5, 1.5e300, 1e-300, -2.5, 1 / 3, float("inf"), float("-inf"), *[draw.uniform(-1, 1) * 10.0 ** draw.randint(-12, 20) for _ in range(300)]]
    got = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").select(eight_digits(F.col("v"))).collect()
    assert [r[0] for r in got] == ["%.8g" % v for v in values] + [None, "nan"]


def test_sources_above_the_cap_are_findings(spark, tmp_path, monkeypatch):
    from corpusflow.sources import files, pages

    (tmp_path / "small.html").write_bytes(b"<p>x</p>")
    (tmp_path / "large.html").write_bytes(b"<p>" + b"x" * 100 + b"</p>")
    monkeypatch.setattr(files, "MAX_BYTES", 50)
    monkeypatch.setattr(pages, "MAX_BYTES", 50)
    assert [r["path"].rsplit("/", 1)[1] for r in files.acquired(spark, str(tmp_path)).collect()] == ["small.html"]
    assert [(r["code"], r["path"].rsplit("/", 1)[1], r["length"]) for r in files.refused(spark, str(tmp_path)).collect()] == [("SOURCE_TOO_LARGE", "large.html", 107)]
    frame = spark.createDataFrame([(1, "<p>x</p>"), (2, "<p>" + "é" * 30 + "</p>"), (3, None)], "page_id long, html string")
    assert [tuple(r) for r in pages.oversized_pages(frame).collect()] == [("SOURCE_TOO_LARGE", 2, 67)]
    assert {r["page_id"] for r in pages.page_elements(frame).collect()} == {1}
