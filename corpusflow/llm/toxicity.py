"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, documents, mix, segment_hashes, small_batches, text_buffers, word_bounds

#: Labelled documents that the model is fitted on at most, drawn by a hash of doc_id: the bound of what is sent to every executor.
MAX_LABELLED = 60_000
#: Leading bytes of a token whose counts are the prior of longer ones; the whole token comes last.
STEMS = (3, 4, 5, 6)
#: Toxic documents that must hold a feature for it to count.
SUPPORT = 3
#: Least log-likelihood ratio statistic of a feature's counts against the base share for positive weight.
SIGNIFICANT = 20.0
#: Strength of a prior in documents; what every token loses, so that neutral text drifts down; fold learnt from and not.
PRIOR, DRIFT, FOLDS, HELD_OUT, CALIBRATION = 6.0, 0.2, 4, 2, 3
LEAST = 0.3
#: What scoring adds to a document's columns.
OUT = "_top double, _n_tokens long, _spans array<struct<start: long, end: long, score: double>>"


def fold(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends, rows and features of the tokens: runs of ASCII letters, digits and non-ASCII bytes, in lower case."""
    low = ascii_lower(buf)
    letter = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    starts, ends, rows = word_bounds(np.where(letter, low, np.uint8(32)), offsets)
    features = [mix(segment_hashes(low, starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in STEMS]
    features.append(mix(segment_hashes(low, starts, ends) + np.uint64(99)))
    return starts, ends, rows, features


def counted(docs: DataFrame, keys=None) -> DataFrame:
    """(key, n): how many texts hold each feature, summed within each batch before the shuffle; with ``keys`` (a broadcast, sorted) only those."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, buf, offsets in text_buffers(batch.column(0)):
                _, _, rows, features = tokens(buf, offsets)
                once = []
                for f in features:
                    if keys is not None:
                        held = at(keys.value, f) >= 0
                        f, own = f[held], rows[held]
                    else:
                        own = rows
                    order = np.lexsort((f, own))
                    f, own = f[order], own[order]
                    once.append(f[np.concatenate(([True], (f[1:] != f[:-1]) | (own[1:] != own[:-1])))] if len(f) else f)
                new, n = np.unique(np.concatenate([found, *once]), return_inverse=True)
                sums = np.zeros(len(new), np.int64)
                np.add.at(sums, n, np.concatenate([counts, np.ones(sum(map(len, once)), np.int64)]))
                found, counts = new, sums
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["key", "n"])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def at(keys: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Positions of ``f`` in sorted ``keys``, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(f), -1)
    k = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
    return np.where(keys[k] == f, k, -1)


@dataclass
class Model:
    """What scoring needs: sorted features with their counts, and the calibration."""

    keys: np.ndarray
    clean: np.ndarray
    toxic: np.ndarray
    n_clean: int
    n_toxic: int
    location: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def weights(self, features: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each token. Its share of toxic documents has a Dirichlet prior around the share of its shorter stem."""
        base = (self.n_toxic + 0.5) / (self.n_toxic + self.n_clean + 1.0)
        share, proof = np.full(len(features[0]), base), np.zeros(len(features[0]))
        for f in features:
            k = at(self.keys, f)
            found = k >= 0
            if not found.any():
                continue
            t, c = np.where(found, self.toxic[k], 0), np.where(found, self.clean[k], 0)
            share = (t + PRIOR * share) / (t + c + PRIOR)
            ratio = 2 * (t * np.log(np.maximum(t, 1) / np.maximum((t + c) * base, 1e-9)) + c * np.log(np.maximum(c, 1) / np.maximum((t + c) * (1 - base), 1e-9)))
            proof = np.where(found, ratio, proof)
        weights = np.log(share / (1 - share)) - math.log(base / (1 - base)) - DRIFT
        return np.where((weights > 0) & (proof < SIGNIFICANT), -DRIFT, weights)


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) of a sequence, in linear time.

    Runs of positive weights are single items here, so the stack walk costs by run; each segment carries the running totals left of
    it and at its end, and joins the ones it dominates.
    """
    above = weights > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], above, [False])).astype(np.int8)))
    total = np.concatenate(([0.0], np.cumsum(weights)))
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, left total, right total, nearest earlier one with a lower left
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right = float(total[s]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((s, e, left, right, j))
                break
            s, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - lft) for s, e, lft, r, _ in stack]


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` with each text's highest segment score, its tokens and the significant segments in code points, as _top, _n_tokens and
    _spans; all columns pass through the one map. ``model`` is a broadcast. A segment is significant if chance brings one as high in a text of its length with odds below 1 in 100."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m: Model = model.value
        for batch in batches:
            n_rows = batch.num_rows
            top, count, spans = np.zeros(n_rows), np.zeros(n_rows, np.int64), [[] for _ in range(n_rows)]
            for first, buf, offsets in text_buffers(batch.column(text_at)):
                starts, ends, rows, features = tokens(buf, offsets)
                if not len(rows):
                    continue
                # a repeated token has its weight each time, else a second passage in the same words would be none
                weights = m.weights(features)
                points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                hot = np.zeros(len(rows) + 1, np.int64)
                np.cumsum(weights > 0, out=hot[1:])
                for k in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[k], bounds[k + 1]
                    count[first + k] = b - a
                    if hot[a] == hot[b]:
                        continue
                    found = maximal_segments(weights[a:b])
                    top[first + k] = max(x[2] for x in found)
                    cutoff = m.location + m.scale * (math.log(b - a) + math.log(100.0))
                    for s, e, score in found:
                        if score >= cutoff:
                            spans[first + k].append({"start": int(points[starts[a + s]] - points[offsets[k]]), "end": int(points[ends[a + e - 1]] - points[offsets[k]]), "score": float(score)})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top), pa.array(count), pa.array(spans, kind)], names=[*batch.schema.names, "_top", "_n_tokens", "_spans"])

    text_at = docs.columns.index("text")
    return docs.mapInArrow(scan, StructType([*docs.schema.fields, *StructType.fromDDL(OUT).fields]))


def excess(top: F.Column, n_tokens: F.Column, location: float, scale: float) -> F.Column:
    """How far a maximal score lies above what a clean text of that length reaches, in scales of the extreme-value distribution."""
    return (top - location) / scale - F.log(F.greatest(n_tokens, F.lit(1)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on labelled documents outside the held-out fold: counts on two folds, calibration on the third.

    At most about ``max_labelled`` labels are used, those with the least hashes of doc_id; they alone are sent to the executors, so
    texts are not shuffled. The driver gets the features of that bounded sample that ``SUPPORT`` toxic texts hold, two moments, and
    a histogram of 400 cells.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    n = max(1, known.count())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = known.filter(draw < int(min(1.0, max_labelled / n) * (1 << 30))).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"), "fold")
    train = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    learn = train.filter(F.col("fold") != CALIBRATION)
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    toxic = counted(learn.filter("toxic = 1")).filter(F.col("n") >= SUPPORT).toPandas()
    order = np.argsort(toxic["key"].to_numpy(np.int64).view(np.uint64))
    keys = toxic["key"].to_numpy(np.int64).view(np.uint64)[order]
    model = Model(keys, np.zeros(len(keys)), toxic["n"].to_numpy(float)[order], sizes.get(0, 0), sizes.get(1, 0))
    clean = counted(learn.filter("toxic = 0"), spark.sparkContext.broadcast(keys)).toPandas()
    model.clean[at(keys, clean["key"].to_numpy(np.int64).view(np.uint64))] = clean["n"]
    raw = scored(train.filter(F.col("fold") == CALIBRATION).select("text", "toxic"), spark.sparkContext.broadcast(model))
    raw = raw.select("toxic", F.col("_top").alias("top"), F.col("_n_tokens").alias("n_tokens")).persist()
    # the maximum over n tokens is extreme-value distributed about location + scale * log(n): both by moments of maxima and log lengths. Texts in
    # which no token has weight have no maximum
    length = F.log(F.greatest("n_tokens", F.lit(1)))
    clean = raw.filter("toxic = 0 and top > 0").agg(F.avg("top").alias("mean"), F.var_pop("top").alias("var"), F.avg(length).alias("length"), F.var_pop(length).alias("spread"), F.count("top").alias("n")).first()
    if clean["n"]:
        model.scale = max(0.05, math.sqrt(clean["var"] / (math.pi**2 / 6 + clean["spread"])))
        model.location = clean["mean"] - model.scale * (clean["length"] + 0.5772156649)
    x = F.greatest(F.lit(-20.0), F.least(F.lit(60.0), excess(F.col("top"), F.col("n_tokens"), model.location, model.scale)))
    cells = raw.groupBy((F.floor(x * 2.5) / 2.5).alias("x"), "toxic").count().toPandas()
    raw.unpersist()
    model.slope, model.shift = logistic(cells["x"].to_numpy(float), cells["toxic"].to_numpy(float), cells["count"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not below a little) and shift of a logistic curve through weighted cells, by Newton's steps."""
    if not len(x):
        return 1.0, -3.0
    beta = np.array([0.1, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-3, float(beta[0])), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.3 on) and spans of the significant toxic passages (start, end, score), as
    _score, _predicted and _spans.

    Scores read the text alone. Without labels of a kind every score stays at the prior's level. Null and empty texts, and texts
    without a token of weight, score 0; repeated rows are scored each; columns of other names pass through.
    """
    with small_batches(docs.sparkSession):
        model = fit(docs, labels, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    x = excess(F.col("_top"), F.col("_n_tokens"), model.location, model.scale)
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), x * model.slope + model.shift))
    found = scored(docs, shared).withColumn("_score", F.when(F.col("_top") <= 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-z))))
    return found.withColumn("_predicted", (F.col("_score") >= LEAST).cast("int")).drop("_top", "_n_tokens")


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null doc_id is not held out."""
    found = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"), F.col("_spans").alias("spans"))
