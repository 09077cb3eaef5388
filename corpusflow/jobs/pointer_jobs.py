"""Queries of JSON documents patched by pointers: customers as documents of their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pointers import assembled, nodes, patched_documents, restored_documents
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def json_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers and their orders: some leaves replaced, priorities in lower case and null tags restored, put together again; and the patches refused."""
    priority = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    order = F.struct(F.col("o_orderkey").alias("key"), priority.alias("priority"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(order)).alias("orders"))
    c = table(spark, sf_dir, "customer").join(orders, "c_custkey")
    tags = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("a/b"))).alias("tags")
    body = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("seg/ment~"), tags).alias("meta"), "orders")
    docs = c.select("c_custkey", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
    # a patch of the first order for half of the documents, and one that can't be made for some of these
    patch = lambda m, r, path, value: c.filter(f"c_custkey % {m} = {r}").select(F.col("c_custkey").alias("id"), F.lit("replace").alias("op"), F.lit(path).alias("path"), F.lit(value).alias("value"))
    patches = patch(2, 0, "/orders/0/priority", '"new"').union(patch(10, 0, "/orders/0", "1")).union(patch(14, 0, "/orders/999/priority", "1")).union(patch(22, 0, "/orders/0/priority", "2")).union(patch(26, 0, "/meta/id", "2"))
    allowed = patches.select("id", "path")
    new, refused = patched_documents(nodes(docs, "c_custkey", "json"), patches, allowed, ["orders", "meta"])
    told = assembled(restored_documents(new, {"/meta/tags": "array"}, {"/orders/*/priority": PRIORITIES}))
    return told.select("id", F.lit("").alias("path"), F.col("json").alias("text")).unionByName(refused.groupBy("id", "path").agg(F.min("code").alias("text")))


QUERIES["json_patches"] = json_patches
ORACLES["json_patches"] = """
WITH c AS (SELECT *, c_custkey % 2 = 0 AND c_custkey % 10 <> 0 AND c_custkey % 14 <> 0 AND c_custkey % 22 <> 0 AND c_custkey % 26 <> 0 AS fine FROM customer),
o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
j AS (SELECT c_custkey, c_mktsegment, string_agg('{"key":' || o_orderkey || ',"priority":"' || CASE WHEN fine AND k = 1 THEN 'new' ELSE o_orderpriority END || '"}', ',' ORDER BY k) AS orders FROM c JOIN o ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey AS id, '' AS path, '{"id":' || c_custkey || ',"meta":{"seg/ment~":"' || c_mktsegment || '","tags":' || CASE WHEN c_custkey % 4 = 0 THEN '["a/b"]' ELSE '[]' END || '},"orders":[' || orders || ']}' AS text FROM j
UNION ALL SELECT c_custkey, '/orders/0', 'INNER_NODE' FROM j WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, '/orders/999/priority', 'NO_SUCH_NODE' FROM j WHERE c_custkey % 14 = 0
UNION ALL SELECT c_custkey, '/orders/0/priority', 'TWICE' FROM j WHERE c_custkey % 22 = 0 UNION ALL SELECT c_custkey, '/meta/id', 'PATH_REFUSED' FROM j WHERE c_custkey % 26 = 0"""
