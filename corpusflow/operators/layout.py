"""Rules over places: captions and their tables, columns of a page, boxes, reserved places in a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that make a line prose, and the share of a page's width by which a column may reach over the middle.
PROSE_WORDS, COLUMN_SLACK = 3, 0.04


def tables_of_captions(blocks: DataFrame, page: str, y: str, key: str, is_caption: Column, is_table: Column, reach: float) -> DataFrame:
    """Each caption with the nearest table below it on its page, at most ``reach`` away and with no other caption between.

    Both are the next ones in the page's order, so two windows do and no pair of blocks is made: read from below, they are the last
    seen so far. Ties in ``y`` go by ``key``.
    """
    below = W.partitionBy(page).orderBy(F.desc(y), F.desc(key)).rowsBetween(W.unboundedPreceding, -1)
    first = lambda when, what: F.last(F.when(when, F.col(what)), ignorenulls=True).over(below)
    near = blocks.withColumns({"_y": first(is_table, y), "_table": first(is_table, key), "_stop": first(is_caption, y), "_caption": is_caption})
    held = (F.col("_y") - F.col(y) <= reach) & (F.col("_stop").isNull() | (F.col("_stop") > F.col("_y")))
    return near.filter("_caption").filter(held).select(page, F.col(key).alias("caption"), F.col("_table").alias("table"))


def column_counts(blocks: DataFrame, page: str, x0: Column, x1: Column, width: float) -> DataFrame:
    """Per page, blocks on the left, on the right and across, and whether the page has two columns."""
    span = (x1 - x0) > 0.6 * width
    left, right = ~span & (x0 < width / 2), ~span & (x0 >= width / 2)
    counts = blocks.groupBy(page).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.count_if(span).alias("n_span"))
    return counts.withColumn("two_columns", (F.col("n_left") > 0) & (F.col("n_right") > 0) & (F.col("n_left") + F.col("n_right") > F.col("n_span")))


def prose_columns(lines: DataFrame, page: str, text: Column, x0: Column, x1: Column, width: Column) -> DataFrame:
    """Per page, lines of prose (PROSE_WORDS words of letters or more) on the left, on the right and across, and whether the page has two columns.

    Formulas and labels are no prose, so fragments on both sides make no columns. A line may reach over the middle by COLUMN_SLACK of the width; a page without lines of prose has one column.
    """
    slack = width * COLUMN_SLACK
    prose = F.regexp_count(text, F.lit("[A-Za-z]{2,}")) >= PROSE_WORDS
    side = F.when(~F.coalesce(prose, F.lit(False)), None).when(x1 <= width / 2 + slack, "left").when(x0 >= width / 2 - slack, "right").otherwise("span")
    counts = lines.groupBy(page).agg(*(F.count_if(side == s).alias(f"n_{s}") for s in ("left", "right", "span")))
    return counts.withColumn("two_columns", (F.col("n_left") > 0) & (F.col("n_right") > 0) & (F.col("n_left") + F.col("n_right") > F.col("n_span")))


def with_reserved(ranked: DataFrame, query: str, group: str, rank: str, k: int) -> DataFrame:
    """Per query the best of each group, and of the others as many as make ``k`` together; ``ranked`` is a bounded top list of each query."""
    marked = ranked.withColumn("protected", F.row_number().over(W.partitionBy(query, group).orderBy(rank)) == 1)
    other = F.sum((~F.col("protected")).cast("int")).over(W.partitionBy(query).orderBy(rank))
    marked = marked.withColumns({"_other": other, "_n": F.sum(F.col("protected").cast("int")).over(W.partitionBy(query))})
    return marked.filter(F.col("protected") | (F.col("_other") <= k - F.col("_n"))).drop("_n", "_other")


def unique_aliases(df: DataFrame, alias: str, target: str) -> DataFrame:
    """Aliases that name one target only."""
    return df.groupBy(alias).agg(F.min(target).alias("low"), F.max(target).alias("high")).filter("low = high").select(alias, F.col("low").alias(target))


def first_occurrences(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Distinct values of each group, numbered by where they first occur."""
    firsts = df.groupBy(group, value).agg(F.min(F.struct(*order)).alias("_at"))
    return firsts.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("_at"))).drop("_at")
