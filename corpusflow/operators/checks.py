"""Consistency rules as queries that give findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ("code", "target", "details")


def duplicates(df: DataFrame, key: str, code: str) -> DataFrame:
    """A finding for every value of ``key`` that occurs more than once."""
    return df.groupBy(key).count().filter("count > 1").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("target"), F.col("count").cast("string").alias("details"))


def unresolved(df: DataFrame, ref: str, to: DataFrame, key: str, code: str) -> DataFrame:
    """A finding for every distinct reference that no ``key`` of ``to`` answers, with how many rows hold it."""
    refs = df.filter(F.col(ref).isNotNull()).groupBy(ref).count()
    missing = refs.join(to.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
    return missing.select(F.lit(code).alias("code"), F.col(ref).cast("string").alias("target"), F.col("count").cast("string").alias("details"))


def violations(df: DataFrame, key: str, rule: Column, code: str) -> DataFrame:
    """A finding for every row that breaks ``rule``; an unknown outcome breaks it."""
    return df.filter(~F.coalesce(rule, F.lit(False))).select(F.lit(code).alias("code"), F.col(key).cast("string").alias("target"), F.lit(None).cast("string").alias("details"))


def findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def worst(status: Column) -> Column:
    """FAIL if any is, else WARN if any is, else PASS; an aggregate."""
    return F.when(F.bool_or(status == "FAIL"), "FAIL").when(F.bool_or(status == "WARN"), "WARN").otherwise("PASS")


def with_status(found: DataFrame, status: str) -> DataFrame:
    return found.withColumn("status", F.lit(status))


def evidence_gate(evidence: DataFrame, sources: DataFrame, group: str, key: str, rank: str, source: str, same: Column, most: int) -> DataFrame:
    """Findings (code, target, details, status) on evidence against its sources, each rule one grouped or joined pass.

    Of each ``group``: ids occur once, ranks are 0 to n - 1, no more than ``most`` blocks (a warning). Of each block: its source exists,
    and ``same`` holds between it and its source.
    """
    groups = evidence.groupBy(group).agg(F.count(key).alias("n"), F.count_distinct(key).alias("ids"), F.count_distinct(rank).alias("ranks"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    told = lambda df, code, details: df.select(F.lit(code).alias("code"), F.col(group).cast("string").alias("target"), details.cast("string").alias("details"))
    both = evidence.join(sources, source)
    parts = [
        with_status(told(groups.filter("n != ids"), "duplicate_evidence", F.col("n") - F.col("ids")), "FAIL"),
        with_status(told(groups.filter("ranks != n or low != 0 or high != n - 1"), "ranks_not_contiguous", F.col("high")), "FAIL"),
        with_status(told(groups.filter(F.col("n") > most), "size_limited", F.col("n")), "WARN"),
        with_status(unresolved(evidence, source, sources, source, "absent_source"), "FAIL"),
        with_status(told(both.filter(~F.coalesce(same, F.lit(False))).groupBy(group).agg(F.count(key).alias("n")), "differs_from_source", F.col("n")), "FAIL"),
    ]
    return findings(*parts)
