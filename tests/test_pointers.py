"""JSON documents as pointer rows: there and back, escapes, places, refusals, defaults."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusflow.operators.pointers import assembled, nodes, patched_documents, restored_documents

DOCS = [
    '{"a": {"b/c": 1, "m~n": [1, 2.5, {"x": null}], "": "empty"}, "z": [], "o": {}, "t": "é\\"\\\\ \\u0001"}', "[1, [2, [3, [4, [5]]]]]", '"only"', "3", "null", "{}", "not json", None,
    json.dumps({"k": {f"n{i}": {"v": [i] * (i % 4)} for i in range(12)}}),
]


def flat(value, pointer=""):
    if isinstance(value, dict | list) and value:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from flat(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")
    elif not isinstance(value, dict | list):
        yield pointer, value


def test_there_and_back(spark):
    frame = spark.createDataFrame(list(enumerate(DOCS)), "doc int, body string")
    rows = nodes(frame, "doc", "body")
    found = {(r["id"], r["pointer"]): json.loads(r["value"]) for r in rows.filter("kind = 'leaf'").collect()}
    whole = {i: json.loads(d) for i, d in enumerate(DOCS) if d and d != "not json"}
    assert found == {(i, p): v for i, d in whole.items() for p, v in flat(d)}
    got = {r["id"]: r["json"] for r in assembled(rows).collect()}
    want = {r["doc"]: r["j"] for r in frame.select("doc", F.to_json(F.try_parse_json("body")).alias("j")).filter("j is not null").collect()}
    assert {i: json.loads(t) for i, t in got.items()} == whole and got == want
    assert nodes(frame.limit(0), "doc", "body").count() == 0


def test_patches(spark):
    body = '{"computations": [{"id": "c", "expression": "x", "more": {"p/q": 1}}], "visuals": [], "other": {"a": 1}}'
    cases = [
        ([("replace", "/computations/0/expression", '"y"')], None), ([("replace", "/computations/0", '"y"')], "INNER_NODE"), ([("replace", "/computations/1/expression", '"y"')], "NO_SUCH_NODE"),
        ([("replace", "/computations/0/id", '"y"')], "PATH_REFUSED"), ([("replace", "/other/a", "2")], "PATH_REFUSED"), ([("replace", "computations/0", "2")], "PATH_REFUSED"), ([("replace", "/computations", "2")], "PATH_REFUSED"),
        ([("add", "/computations/0/expression", "2")], "NOT_A_REPLACE"), ([("replace", "/computations/0/expression", "{")], "NOT_A_REPLACE"), ([("replace", "/computations/0/more/p~1q", "2")], "PATH_REFUSED"),
        ([("replace", "/computations/0/expression", "1"), ("replace", "/computations/0/expression", "2")], "TWICE"), ([("replace", f"/computations/0/e{i}", "1") for i in range(9)], "TOO_MANY"),
        ([("replace", "/visuals/0", "1")], "NO_SUCH_NODE"), ([("replace", "/computations/0/more", "1"), ("replace", "/computations/0/expression", '"z"')], "INNER_NODE"), ([("replace", None, "1")], "PATH_REFUSED"),
    ]
    docs = spark.createDataFrame([(i, body) for i in range(len(cases) + 1)], "doc int, body string")
    patches = spark.createDataFrame([(i, *p) for i, (own, _) in enumerate(cases) for p in own], "id int, op string, path string, value string")
    allowed = patches.select("id", "path").union(spark.createDataFrame([(99, "/x/y")], "id int, path string"))
    new, refused = patched_documents(nodes(docs, "doc", "body"), patches, allowed, ["computations", "visuals"])
    codes = {}
    for r in refused.collect():
        codes.setdefault(r["id"], set()).add(r["code"])
    assert codes == {i: {code} for i, (_, code) in enumerate(cases) if code}
    out = {r["id"]: json.loads(r["json"]) for r in assembled(new).collect()}
    want = json.loads(body)
    assert all(out[i] == want for i in out if i) and len(out) == len(cases) + 1
    want["computations"][0]["expression"] = "y"
    assert out[0] == want
    # with escapes let through, and a patch that nobody allowed
    one = patches.filter("path like '%~%'")
    new, refused = patched_documents(nodes(docs, "doc", "body"), one, one, ["computations"], escaped=True)
    assert refused.count() == 0 and json.loads(assembled(new).filter("id = 9").first()["json"])["computations"][0]["more"] == {"p/q": 2}
    assert [r["code"] for r in patched_documents(nodes(docs, "doc", "body"), patches.filter("id = 0"), allowed.filter("id = 99"), ["computations"])[1].collect()] == ["NOT_ALLOWED"]


def test_restored(spark):
    body = '{"a": null, "b": {"x": {"refs": null, "kind": "derived"}, "y": {"refs": [1], "kind": "Nothing"}}, "c": [{"kind": "DERIVED", "refs": null}, {"kind": 3}], "s": null}'
    rows = nodes(spark.createDataFrame([(1, body)], "doc int, body string"), "doc", "body", maps=("/b",))
    got = restored_documents(rows, {"/a": "object", "/b/*/refs": "array", "/c/*/refs": "array"}, {"/b/*/kind": ["DERIVED", "OTHER"], "/c/*/kind": ["Derived", "x"]})
    assert json.loads(assembled(got).first()["json"]) == {"a": {}, "b": {"x": {"refs": [], "kind": "DERIVED"}, "y": {"refs": [1], "kind": "Nothing"}}, "c": [{"kind": "Derived", "refs": []}, {"kind": 3}], "s": None}
