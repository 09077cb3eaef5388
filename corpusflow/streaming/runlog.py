"""Run logs: roll-up, running budgets, and streams of events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A run's limits of calls, of tokens, and of seconds.
MAX_CALLS, MAX_TOKENS, MAX_SECONDS = 10, 30_000, 600


def rollup(events: DataFrame, run: str, order: list[str], kind: str, amount: str, failed: str = "error") -> DataFrame:
    """By run: events, failures, sum of amounts, and the kind of the last event. All are sums that combine before the shuffle."""
    last = F.max_by(F.col(kind), F.struct(*order))
    return events.groupBy(run).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == failed).alias("failures"), F.round(F.sum(amount), 2).alias("amount"), last.alias("last"))


def running_budget(events: DataFrame, run: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """Each event with what its run has spent so far, and whether a next one would still be authorised."""
    window = W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("spent", F.sum(cost).over(window)).withColumn("calls", F.row_number().over(W.partitionBy(run).orderBy(*order))).withColumn("within", F.col("spent") <= limit)


def windowed(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling window and event type, of a table or a stream; ``late`` is a stream's watermark."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions by user: events less than ``gap`` apart."""
    if late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in the schema that they have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
