"""Tags, unsafe rows, assets and figures of pages, one case each."""

from __future__ import annotations

import pytest

from corpusflow.sources.tags import BODY, ITSELF, asset_findings, figure_rows, figures_of, tag_rows, tags_of, unsafe_rows


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a b='1' C=\"2\" d=3 e f='x>y'>", [("a", "b", "1"), ("a", "c", "2"), ("a", "d", "3"), ("a", "e", None), ("a", "f", "x>y")]),
        ("<!-- <a b=1> --><p q='&lt;&amp;'>", [("p", "q", "<&")]),
        ("<script>if (a<b) '<i x=1>'</script><b y=2>", [("script", BODY, "if (a<b) '<i x=1>'"), ("b", "y", "2")]),
        ("<style>a{}</style>", [("style", BODY, "a{}")]),
        ("<br/><img a/ b=/x>", [("img", "a", None), ("img", "b", "/x")]),
        ("a < b <", []),
        ("<script>open", [("script", BODY, "open")]),
        ("<p x=1 x=2>", [("p", "x", "1"), ("p", "x", "2")]),
    ],
)
def test_tags(html, want):
    assert [r[1:] for r in tags_of(html) if r[2] != ITSELF] == want


UNSAFE = {
    "<img src='http://x' onload='f()'>": {"external_dependency", "unsafe_html"}, "<a href=javascript:f()>": {"unsafe_link"}, '<input disabled onclick="f()">': {"unsafe_html"}, "<a href='#x'><a href=http://x>": set(),
    "<img srcset='data:,x'>": {"external_dependency"}, "<script src='data:,x'></script>": {"external_dependency"}, "<img src='data:,x'>": set(), "<img src>": set(), "<link rel=x>": {"external_dependency"}, "<object>": {"external_dependency"},
    "<meta http-equiv=REFRESH>": {"external_dependency"}, "<meta http-equiv=x>": set(), "<use xlink:href='#a'>": set(), "<use href='a'>": {"external_dependency"}, "<p style='background:url(data:,x)'>": set(), "<p style='a:url( \"x\")'>": {"external_dependency"},
    "<style>@IMPORT 'x'</style>": {"external_dependency"}, "<script>new Function ('x')</script>": {"forbidden_runtime"}, "<script>prefetch('x')</script>": set(), "<a href=' file:x'>": {"unsafe_link"}, "<form action=/x>": {"external_dependency"},
}


def test_unsafe_and_assets(spark):
    pages = spark.createDataFrame(list(enumerate(UNSAFE)) + [(99, None)], "page int, html string")
    rows = tag_rows(pages, "page", "html")
    found = {i: set() for i in range(len(UNSAFE))}
    for r in unsafe_rows(rows).collect():
        found[r["page"]].add(r["code"])
    assert found == dict(enumerate(UNSAFE.values()))
    manifest = "<script type='application/json' id=m>{}</script>"
    bodies = [("<style></style><script>x</script>" + manifest, set()), ("<style></style>" + manifest, {"assets_missing"}), ("<script>x</script><style></style>", {"manifest_invalid"}), ("<p>", {"assets_missing", "manifest_invalid"}), ("<style></style><script></script>" + manifest * 2, {"manifest_invalid"})]
    rows = tag_rows(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "page int, html string"), "page", "html")
    got = {i: set() for i in range(len(bodies))}
    for r in asset_findings(rows, "page", "m").collect():
        got[r["page"]].add(r["code"])
    assert got == {i: w for i, (_, w) in enumerate(bodies)}


def test_figures(spark):
    assert figures_of("<figure><img alt=a><figcaption>One <b>two</b></figcaption>rest</figure><figure>t</figure>") == [(0, "One two", [], ["a"]), (1, "t", [], [])]
    assert figures_of("<figure><figure><text>in</text><img></figure><figcaption>Out") == [(0, "Out", ["in"], [""]), (1, "in", ["in"], [""])]
    got = figure_rows(spark.createDataFrame([(1, "<figure>" + "<img alt=x>" * 9 + "</figure>"), (2, None), (3, "none")], "page int, html string"), "page", "html", most=4).collect()
    assert [(r["page"], r["alts"]) for r in got] == [(1, ["x"] * 4)]
