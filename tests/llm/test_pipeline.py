"""The pipeline's stages, one after another, against plain versions of what each has to do."""

from __future__ import annotations

import random
import re
import uuid

import corpus_pipeline
from corpusflow.llm import toxicity
from corpusflow.llm.common import stage

from .helpers import text_of, with_clashes
from .test_text_dedup import brute_runs, near, shingles, union


def corpus(draw):
    texts, labels = {}, []
    for i in range(240):
        t = "\n".join(text_of(draw, draw.randint(6, 14)) for _ in range(draw.randint(2, 7)))
        if i % 6 == 0:
            w = t.split(" ")
            for _ in range(5):
                w.insert(draw.randrange(len(w)), draw.choice(["vilex", "grotz", "snarfel"]))
            t = " ".join(w)
        labels.append((i, 1, int(i % 6 == 0)))
        texts[i] = t
    block = "\n".join(text_of(draw, 9) for _ in range(3))
    for i in range(1, 240, 30):
        texts[i] += "\n" + block
    for k, i in enumerate(range(1, 200, 9)):
        texts[300 + k] = near(draw, texts[i].replace("\n", " "), 1)
    texts |= {400: None, 401: ""}
    return texts, labels


def test_pipeline(spark, tmp_path):
    texts, labels = corpus(random.Random(12))
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = with_clashes(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    left = dict(texts)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        if name == "toxicity":
            gone = left.keys() - dict(got).keys()
            bad = {i for i in left if "vilex" in (left[i] or "") or "grotz" in (left[i] or "") or "snarfel" in (left[i] or "")}
            assert len(gone ^ bad) <= 3
        elif name == "line_dedup":
            cut = brute_runs(left, 2)
            want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i]) for i, t in left.items()}
            assert dict(got) == want and len(got) == len(left)
        elif name == "near_duplicates":
            sets = {i: shingles(t, 5) for i, t in left.items()}
            pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            first = union(pairs, sets)
            assert dict(got) == {i: t for i, t in left.items() if first[i] == i} and pairs
        else:
            assert set(got) <= set(left.items()) and all(got.count(x) <= 3 for x in got)
            assert {400, 401} <= dict(got).keys()
            size = lambda t: len(re.findall(r"\S+", t or ""))
            total = sum(size(t) for t in left.values())
            assert abs(sum(size(t) for _, t in got) - total) <= 0.1 * total
        left, docs = dict(got), out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(left)
    assert corpus_pipeline.ORACLE_SQL is None
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, str(tmp_path)).count() == 0


def test_scoring_takes_small_batches_when_the_caller_writes(spark, monkeypatch, tmp_path):
    log, buffers = tmp_path / "sizes", toxicity.text_buffers
    log.mkdir()

    def counted(column):
        (log / uuid.uuid4().hex).write_text(str(len(column)))
        return buffers(column)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(toxicity, "text_buffers", counted)
    spark.createDataFrame([(i, f"some text {i}") for i in range(2500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    try:
        out = corpus_pipeline.toxicity(spark, spark.read.parquet(str(tmp_path / "documents")), str(tmp_path))
        out.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2500
    sizes = [int(f.read_text()) for f in log.iterdir()]
    assert sum(sizes) >= 2500 and max(sizes) <= 1000
