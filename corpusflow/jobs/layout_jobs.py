"""Queries of places, reserved ranks, aliases and ordered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.layout import column_counts, first_occurrences, tables_of_captions, unique_aliases, with_reserved
from ..operators.search import ranked
from .search_jobs import PRELUDE, docs, keys

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def caption_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks of their customer's pages: prices are places, finished orders captions, open ones tables."""
    found = tables_of_captions(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", 50_000.0)
    return found


def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = F.when(F.col("l_quantity") % 7 == 0, 0.0).when(F.col("l_quantity") % 2 == 0, 5.0).otherwise(55.0)
    return column_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", x0, x0 + F.when(F.col("l_quantity") % 7 == 0, 100.0).otherwise(40.0), 100.0)


def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


def reserved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the best fifty candidates of every query, the best of every language among them."""
    top = ranked(keys(spark, sf_dir), 50).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return with_reserved(top, "query", "lang", "rank", 10).select("query", "doc_id", "rank", "protected")


def length_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", (1 + F.least(F.length("text"), F.lit(1200)) / 200).alias("boost"))


def alias_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, rounded, that name one nation."""
    customers = table(spark, sf_dir, "customer").withColumn("alias", F.floor(F.col("c_acctbal") / 10).cast("long"))
    return unique_aliases(customers, "alias", "c_nationkey")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_occurrences(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return found.withColumn("place", F.col("place").cast("long"))


def text_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as one text; a conversation is a bounded group."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("digest"), F.size("t").cast("long").alias("n_turns"))


def context_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For assistant turns as anchors, the user turns one place before and after."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    near = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("anchor"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return near.join(turns.filter("role = 'user'"), ["conv_id", "turn"]).select("conv_id", "anchor", "turn")


def batches_of_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand in batches of at most 24, in their order."""
    n = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor((n - 1) / 24).alias("batch"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme and host of page addresses, and whether they lead onto the network."""
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), F.col("url").rlike("(?i)^(https?|wss?):").alias("network"))


QUERIES |= {f.__name__: f for f in (caption_tables, two_column_pages, box_union, reserved_topk, length_boost, alias_unique, ordered_distinct, text_in_order, context_turns, batches_of_24, url_parts)}
ORACLES |= {
    "caption_tables": """WITH c AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
      n AS (SELECT c.o_custkey, c.o_orderkey AS caption, c.o_totalprice AS y, t.o_orderkey AS "table", t.o_totalprice AS ty,
        row_number() OVER (PARTITION BY c.o_orderkey ORDER BY t.o_totalprice, t.o_orderkey) AS k FROM c JOIN t ON c.o_custkey = t.o_custkey AND (t.o_totalprice, t.o_orderkey) > (c.o_totalprice, c.o_orderkey))
      SELECT o_custkey, caption, "table" FROM n WHERE k = 1 AND ty - y <= 50000 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.o_custkey = n.o_custkey AND (d.o_totalprice, d.o_orderkey) > (n.y, n.caption) AND d.o_totalprice <= n.ty)""",
    "two_column_pages": """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_quantity % 7 <> 0 AND l_quantity % 2 = 0) AS n_left, count(*) FILTER (l_quantity % 7 <> 0 AND l_quantity % 2 <> 0) AS n_right, count(*) FILTER (l_quantity % 7 = 0) AS n_span FROM lineitem GROUP BY 1)
      SELECT *, n_left > 0 AND n_right > 0 AND n_left + n_right > n_span AS two_columns FROM s""",
    "box_union": "SELECT l_suppkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1",
    "reserved_topk": PRELUDE + """, t AS (SELECT query, doc_id, rank, row_number() OVER (PARTITION BY query, lang ORDER BY rank) = 1 AS protected FROM ranks JOIN documents USING (doc_id) WHERE rank <= 50),
      o AS (SELECT *, sum((NOT protected)::INT) OVER (PARTITION BY query ORDER BY rank) AS other, count(*) FILTER (protected) OVER (PARTITION BY query) AS n FROM t) SELECT query, doc_id, rank, protected FROM o WHERE protected OR other <= 10 - n""",
    "length_boost": "SELECT doc_id, 1 + least(length(text), 1200) / 200 AS boost FROM documents",
    "alias_unique": "SELECT CAST(floor(c_acctbal / 10) AS BIGINT) AS alias, min(c_nationkey) AS c_nationkey FROM customer GROUP BY 1 HAVING min(c_nationkey) = max(c_nationkey)",
    "ordered_distinct": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS place FROM f",
    "text_in_order": "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, count(*) AS n_turns FROM conversations GROUP BY conv_id",
    "context_turns": "SELECT a.conv_id, a.turn AS anchor, u.turn FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND abs(a.turn - u.turn) = 1 WHERE a.role = 'assistant' AND u.role = 'user'",
    "batches_of_24": "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 24 AS batch FROM part",
    "url_parts": "SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host, regexp_matches(url, '(?i)^(https?|wss?):') AS network FROM pages",
}
