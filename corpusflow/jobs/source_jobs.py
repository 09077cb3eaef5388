"""Queries of page sources, run logs and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import eight_digits, format_of
from ..sources.pages import page_elements, reading_order, repeated_edges, section_parents, sectioned
from ..streaming.runlog import rollup, running_budget, sessions, windowed
from ..streaming.traces import stage_results

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html")
    head = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  %PDF-1.7"), F.substring("html", 1, 100))).when(F.col("page_id") % 5 == 1, "plain").otherwise(F.substring("html", 1, 8192))
    return pages(spark, sf_dir).select("page_id", format_of(head, mime).alias("format"))


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def page_element_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_elements(pages(spark, sf_dir)).select("page_id", "source_order", "tag", "content", "reliable")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectioned(page_elements(pages(spark, sf_dir))).groupBy("page_id", "section_order", "noise").agg(F.count("*").alias("n_elements"), F.sum(F.length("content")).alias("n_chars"))


def section_parent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as sections of levels 1 to 4, with their parents."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 4 + 1).cast("int").alias("level"))
    return section_parents(lines, "l_orderkey", "l_linenumber", "level").select("l_orderkey", "l_linenumber", "level", "parent")


def repeated_edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host, navigation links that stand on two pages or more and on half of the host's pages."""
    all_pages = pages(spark, sf_dir).withColumn("host", F.regexp_extract("url", "://([^/:?#]+)", 1))
    found = all_pages.select("host", "page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<li><a href=\"[^\"]*\">([^<]*)</a></li>"))).alias("text"))
    return repeated_edges(found, all_pages, "host", "page_id", "text")


def reading_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of their supplier's pages: places from quantity and price, widths from narrow to full."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x0 = F.when(F.col("l_quantity") % 7 == 0, 30.0).when(F.col("l_quantity") % 2 == 0, 2.0).otherwise(52.0)
    blocks = items.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", x0.alias("x0"), F.col("l_extendedprice").alias("y0"), (x0 + 40).alias("x1")).distinct()
    return reading_order(blocks, "l_suppkey", F.lit(100.0), ("l_orderkey", "l_linenumber", "l_partkey")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("y0", 2).alias("y0"), "x0", F.col("reading").cast("long").alias("reading"))


QUERIES |= {"format_sniff": format_sniff, "title_extract": title_extract, "page_elements": page_element_rows, "page_sections": page_sections, "section_parents": section_parent_rows, "repeated_edge_text": repeated_edge_text, "reading_order": reading_order_rows}
ORACLES |= {
    "format_sniff": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 <> 1 AND regexp_matches(lower(substr(html, 1, 8192)), '<!doctype html|<html|<article|<body') THEN 'html'
      WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS format FROM pages""",
    "title_extract": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    "section_parents": """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(min(l_partkey) % 4 + 1 AS INTEGER) AS level FROM lineitem GROUP BY 1, 2)
      SELECT a.l_orderkey, a.l_linenumber, a.level, max(b.l_linenumber) AS parent FROM s a LEFT JOIN s b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level GROUP BY 1, 2, 3""",
    "repeated_edge_text": """WITH p AS (SELECT *, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages), n AS (SELECT host, count(DISTINCT page_id) AS n FROM p GROUP BY 1)
      SELECT host, text, count(DISTINCT page_id) AS n_pages FROM (SELECT host, page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS text FROM p) JOIN n USING (host) GROUP BY host, text HAVING count(DISTINCT page_id) >= greatest(2, max(n) // 2)""",
    "reading_order": """WITH b AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y0, CASE WHEN l_quantity % 7 = 0 THEN 30.0 WHEN l_quantity % 2 = 0 THEN 2.0 ELSE 52.0 END::DOUBLE AS x0 FROM lineitem),
      c AS (SELECT *, x0 + 40 <= 54 AS is_left, x0 >= 46 AS is_right FROM b),
      d AS (SELECT *, NOT is_left AND NOT is_right AS span, bool_or(is_right) OVER p AND bool_or(is_left) OVER p AS two FROM c WINDOW p AS (PARTITION BY l_suppkey)),
      s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY y0, x0, l_orderkey, l_linenumber, l_partkey) AS k FROM d WHERE span),
      e AS (SELECT d.*, CASE WHEN NOT d.two THEN 0 WHEN d.span THEN s.k ELSE coalesce((SELECT max(t.k) FROM s t WHERE t.l_suppkey = d.l_suppkey AND t.y0 <= d.y0), 0) END AS band
        FROM d LEFT JOIN s USING (l_suppkey, l_orderkey, l_linenumber, l_partkey, y0, x0))
      SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(y0, 2) AS y0, x0, row_number() OVER (PARTITION BY l_suppkey ORDER BY band, CASE WHEN NOT two OR span THEN 0 WHEN is_right THEN 2 ELSE 1 END, y0, x0, l_orderkey, l_linenumber, l_partkey) AS reading FROM e""",
}


def runlog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "value")


def stage_last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: of every kind of event how many there are and how the last ended, and all kinds of a user as one text."""
    ended = F.when(F.col("value") >= 50, "pass").when(F.col("value") >= 10, "warn").otherwise("fail")
    last = stage_results(events(spark, sf_dir).withColumn("ended", ended), "user_id", "event_type", "ended", ["ts", "event_id"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "result"))), lambda x: F.concat_ws("=", x["event_type"], x["result"])), " ")
    return last.groupBy("user_id").agg(F.sum("n").alias("n"), whole.alias("results"))


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' prices at scales from 1e-7 to 1e11 as texts of eight digits."""
    scale = F.pow(F.lit(10.0), F.col("l_linenumber") * 3 - 12)
    value = F.col("l_extendedprice") / 7 * scale * F.when(F.col("l_partkey") % 2 == 0, -1).otherwise(1)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 50 == 0, F.lit(0.0)).when(F.col("l_partkey") % 10 == 0, F.floor(F.col("l_extendedprice")).cast("double")).otherwise(value).alias("v")).groupBy(eight_digits(F.col("v")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = events(spark, sf_dir).withColumn("cost", F.floor(F.col("value")).cast("long"))
    return running_budget(cost, "user_id", ["ts", "event_id"], "cost", 500).select("event_id", "spent", F.col("calls").cast("long").alias("calls"), "within")


def observation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per return flag, what changes from the first line status to the second, as a sentence."""
    by = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("before"), F.sum(F.when(F.col("l_linestatus") != "F", F.col("l_quantity"))).alias("after"))
    told = lambda c: F.col(c).cast("long").cast("string")
    return by.select("l_returnflag", F.concat_ws("; ", F.concat(F.lit("quantity from "), told("before"), F.lit(" to "), told("after"))).alias("observation"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(events(spark, sf_dir)).withColumn("value", F.round("value", 4))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(events(spark, sf_dir))


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).cube("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view before or at it: one window, no pairs."""
    window = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = events(spark, sf_dir).withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(window))
    return seen.filter("event_type = 'purchase'").select("event_id", "view_id")


QUERIES |= {f.__name__: f for f in (runlog_rollup, stage_last_results, number_text, budget_running, observation_text, event_windows, event_sessions, event_cube, asof_last_view)}
ORACLES |= {
    "runlog_rollup": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 2) AS amount, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id",
    "stage_last_results": """WITH k AS (SELECT user_id, event_type, count(*) AS n, arg_max(CASE WHEN value >= 50 THEN 'pass' WHEN value >= 10 THEN 'warn' ELSE 'fail' END, (ts, event_id)) AS r FROM events GROUP BY 1, 2)
      SELECT user_id, sum(n)::BIGINT AS n, string_agg(event_type || '=' || r, ' ' ORDER BY event_type) AS results FROM k GROUP BY 1""",
    "number_text": """SELECT printf('%.8g', CASE WHEN l_partkey % 50 = 0 THEN 0::DOUBLE WHEN l_partkey % 10 = 0 THEN floor(l_extendedprice)::DOUBLE ELSE l_extendedprice / 7 * pow(10::DOUBLE, l_linenumber * 3 - 12) * CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END END) AS text, count(*) AS n FROM lineitem GROUP BY 1""",
    "budget_running": "SELECT event_id, CAST(sum(floor(value)::BIGINT) OVER w AS BIGINT) AS spent, row_number() OVER w AS calls, sum(floor(value)::BIGINT) OVER w <= 500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "observation_text": "SELECT l_returnflag, 'quantity from ' || sum(l_quantity) FILTER (l_linestatus = 'F')::BIGINT || ' to ' || sum(l_quantity) FILTER (l_linestatus <> 'F')::BIGINT AS observation FROM lineitem GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_cube": "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, date_trunc('day', ts))",
    "asof_last_view": "WITH v AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS view_id FROM events) SELECT event_id, view_id FROM v WHERE event_type = 'purchase'",
}
