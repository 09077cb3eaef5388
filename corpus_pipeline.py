"""Corpus preparation in five stages: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows, written as Parquet, are the next stage's ``docs``. All but the
last return the columns of ``docs``, whatever other columns they have. Null and empty texts and null doc_ids pass every filter, repeated ids
stand for rows of their own, and an empty table passes through. Tables that a stage writes for itself are gone when it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import Scratch, batches_at_most, documents, row_keys, sent, stage
from corpusflow.llm.jaccard import jaccard_classes
from corpusflow.llm.line_runs import repeated_runs, without_runs
from corpusflow.llm.mixing import taken_rows, words_of
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic. The session's batches are small from here on, as texts are scored when the caller writes the result."""
    batches_at_most(spark)
    # columns that may be called like those that scoring adds
    other = {c: f"kept{i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    scored = score_toxicity(docs.withColumnsRenamed(other), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("_predicted = 0")
    return scored.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops later copies of runs of two lines or more, or of one long line."""
    return without_runs(docs, repeated_runs(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by a similarity of 0.8 of five-word shingles: that of least doc_id (null last), then of least text key.
    Texts without words are in no group. Rows are told apart by id and text, so a text goes only if a row like it stays."""
    told = jaccard_classes(docs, row_keys("doc_id", "text") + [F.col("doc_id").cast("long").alias("doc_id")], words=5, num=4, den=5).filter("class is not null")
    with Scratch(spark) as scratch:
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
        rows = scratch.stage(told.groupBy("class", place.alias("place")).agg(F.count("k1").alias("times")), "rows")
        first = rows.groupBy("class").agg(F.min("place").alias("first"))
        judged = rows.join(first, "class").select("place.k1", "place.k2", F.col("place").eqNullSafe(F.col("first")).alias("stays"), "times").filter("not stays or times > 1")
        judged = stage(judged, "judged")
    gone, twice = stage(judged.filter("not stays").select("k1", "k2"), "gone"), stage(judged.filter("stays").select("k1", "k2"), "twice")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys("doc_id", "text")).join(sent(gone), ["k1", "k2"], "left_anti")
    if not twice.isEmpty():  # rows that stay and are there several times
        once = keyed.join(sent(twice), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        keyed = keyed.join(sent(twice), ["k1", "k2"], "left_anti").unionByName(once)
    return keyed.select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that sources come near their targets; a document taken n times is n rows. Texts without words fill no quota and stay."""
    return taken_rows(docs, words_of(docs), F.array("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the fitted model nor the packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
