"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, running_totals, stage

ROUNDS = 6
#: Walks after which no row number can still lie outside for small tables, nor is likely to (below 2**-300) for large ones.
MAX_WALKS = 64


def permuted(row_no: Column, n: int, seed: int) -> Column:
    """Where ``row_no`` goes in a keyed permutation of 0 to n - 1. Rounds alternate between the halves of x = a * right + left,
    with left < a and right < b for the least a * b >= n near a square; results outside 0 to n - 1 walk on along their cycle."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    at = lambda k, x, m: F.pmod(F.xxhash64(F.lit(seed).cast("long"), k.cast("long"), x.cast("long")), F.lit(m).cast("long"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + at(k, s["r"], a)) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + at(k, s["l"], b)) % b).alias("r"),
        )

    def once(x: Column) -> Column:
        first = F.struct((x % a).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda s: s["r"] * a + s["l"])

    walks = min(a * b - n + 1, MAX_WALKS)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(row_no), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end: choose another seed")))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 2026) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 8), text_crc32, row_no, shard, slot.

    The permuted row number p gives shard p mod ``shards`` and slot p div ``shards``, so counts differ by one at most, slots have no
    gaps, and both can be computed from (row_no, row count, seed) alone. Row numbers follow doc_id, checksum and size; rows equal in all
    three are interchangeable, and are ranged by their place in the input so that no task holds them all. Null text counts as empty; null doc_id sorts first;
    an empty table gives no rows; other columns of ``docs`` are not read. Texts that are equal go to any shards: counts that differ by
    one at most leave no room to keep groups together.
    """
    with Scratch(docs.sparkSession) as scratch:
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
        rows = scratch.stage(rows.withColumn("nth", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), "rows")
        numbered = stage(running_totals(rows, ["doc_id", "text_crc32", "size", "nth"], "one", "row_no", scratch.stage).drop("nth", "one"), "numbered")
    n = numbered.count()
    placed = numbered.withColumn("p", permuted(F.col("row_no"), n, seed)) if n else numbered.withColumn("p", F.lit(0).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", "row_no", (F.col("p") % shards).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
