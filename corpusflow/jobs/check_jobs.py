"""Queries of consistency rules, graphs, claims and JSON, on the star schema, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import extra_keys, recovered, strict
from ..functions.text import safe_json
from ..operators.closure import reachable
from ..operators.checks import duplicates, findings, same_set, subset, unresolved, violations, worst

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders and documents without labels, as counted findings."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    idle = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").groupBy("c_mktsegment").count()
    unlabelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").count()
    return idle.select(F.lit("no_order").alias("code"), F.col("c_mktsegment").alias("target"), "count").unionByName(unlabelled.select(F.lit("no_label").alias("code"), F.col("lang").alias("target"), "count"))


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return findings(duplicates(items.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", "duplicate_line"), duplicates(table(spark, sf_dir, "documents"), "doc_id", "duplicate_document"))


def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return findings(
        unresolved(items, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey", "unknown_order"),
        unresolved(items, "l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey", "unknown_supplier"),
        unresolved(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer"), "c_custkey", "unknown_user"),
    )


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return findings(
        violations(orders, "o_orderkey", (F.col("o_totalprice") > 0) & (F.col("o_totalprice") < 490_000), "price_range"),
        violations(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal") >= 0, "negative_balance"),
    ).select("code", "target")


def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, whether its return flags are a subset of, or the same as, A and N; per order an array of at most three flags."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    wanted = F.array(F.lit("A"), F.lit("N"))
    return sets.select("l_orderkey", subset(F.col("flags"), wanted).alias("is_subset"), same_set(F.col("flags"), wanted).alias("is_same"), F.size(F.array_intersect("flags", wanted)).cast("long").alias("n_common"))


def owner_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order that more than one line owns."""
    owned = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("owners"), F.min("l_linenumber").alias("first_line"))
    return owned.filter("owners > 1")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers, with suppliers, with both, and with one kind alone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "customers_only": c.exceptAll(s), "suppliers_only": s.exceptAll(c)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("operation"), "nation")
        out = df if out is None else out.unionByName(df)
    return out


def reach_region_to_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers and orders each region reaches through nation, customer and order edges."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("a"), b.alias("b"))
    edges = edge(table(spark, sf_dir, "nation"), node("r", "n_regionkey"), node("n", "n_nationkey"))
    edges = edges.union(edge(table(spark, sf_dir, "customer"), node("n", "c_nationkey"), node("c", "c_custkey")))
    edges = edges.union(edge(table(spark, sf_dir, "orders"), node("c", "o_custkey"), node("o", "o_orderkey")))
    found = reachable(edges, table(spark, sf_dir, "region").select(node("r", "r_regionkey").alias("start")))
    return found.groupBy("start", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


def claims_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank text of a part as a claim row with its place."""
    rows = table(spark, sf_dir, "part").unpivot(["p_partkey"], ["p_name", "p_brand", "p_type"], "field", "claim").filter(F.trim("claim") != "")
    return rows.select(F.concat_ws(".", F.lit("claim-part"), F.col("p_partkey").cast("string"), "field").alias("claim_id"), "claim")


def claims_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against records, both ways: parts sold against parts listed, and what each side lacks."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n_sold"))
    listed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    both = listed.join(sold, "key", "full_outer")
    kind = F.when(F.col("p_brand").isNull(), "unlisted").when(F.col("n_sold").isNull(), "unsold").otherwise("matched")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_sold"), F.lit(0)).alias("n_sold"))


def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "purchase", "WARN").otherwise("PASS")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(worst(status).alias("status"), F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (ref_anti, dup_ids, unresolved_refs, rule_findings, set_subset, owner_unique, set_operations, reach_region_to_order, claims_unpivot, claims_grounded, report_status)}
ORACLES |= {
    "ref_anti": """SELECT 'no_order' AS code, c_mktsegment AS target, count(*) AS count FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 2
      UNION ALL SELECT 'no_label', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""",
    "dup_ids": """SELECT 'duplicate_line' AS code, concat(l_orderkey, '-', l_linenumber) AS target, count(*)::VARCHAR AS details FROM lineitem GROUP BY 2 HAVING count(*) > 1
      UNION ALL SELECT 'duplicate_document', doc_id::VARCHAR, count(*)::VARCHAR FROM documents GROUP BY 2 HAVING count(*) > 1""",
    "unresolved_refs": """SELECT 'unknown_order' AS code, l_orderkey::VARCHAR AS target, count(*)::VARCHAR AS details FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
      UNION ALL SELECT 'unknown_supplier', l_suppkey::VARCHAR, count(*)::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 2
      UNION ALL SELECT 'unknown_user', user_id::VARCHAR, count(*)::VARCHAR FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2""",
    "rule_findings": """SELECT 'price_range' AS code, o_orderkey::VARCHAR AS target FROM orders WHERE NOT (o_totalprice > 0 AND o_totalprice < 490000)
      UNION ALL SELECT 'negative_balance', c_custkey::VARCHAR FROM customer WHERE NOT c_acctbal >= 0""",
    "set_subset": """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1)
      SELECT l_orderkey, list_has_all(['A', 'N'], f) AS is_subset, list_has_all(['A', 'N'], f) AND len(f) = 2 AS is_same, CAST(len(list_intersect(f, ['A', 'N'])) AS BIGINT) AS n_common FROM s""",
    "owner_unique": "SELECT l_orderkey, l_partkey, count(*) AS owners, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "set_operations": """WITH c AS (SELECT DISTINCT c_nationkey AS nation FROM customer), s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier)
      SELECT 'union' AS operation, nation FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'intersect', nation FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
      UNION ALL SELECT 'customers_only', nation FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'suppliers_only', nation FROM (SELECT * FROM s EXCEPT SELECT * FROM c)""",
    "reach_region_to_order": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
      f AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node FROM region UNION SELECT f.start, e.b FROM f JOIN e ON f.node = e.a)
      SELECT start, substr(node, 1, 1) AS kind, count(*) AS n FROM f GROUP BY 1, 2""",
    "claims_unpivot": """SELECT 'claim-part.' || p_partkey || '.' || field AS claim_id, claim FROM (SELECT p_partkey, 'p_name' AS field, p_name AS claim FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) WHERE trim(claim) <> ''""",
    "claims_grounded": """WITH s AS (SELECT l_partkey AS key, count(*) AS n_sold FROM lineitem GROUP BY 1)
      SELECT CASE WHEN p_partkey IS NULL THEN 'unlisted' WHEN n_sold IS NULL THEN 'unsold' ELSE 'matched' END AS kind, count(*) AS n, CAST(coalesce(sum(n_sold), 0) AS BIGINT) AS n_sold FROM part FULL JOIN s ON p_partkey = key GROUP BY 1""",
    "report_status": "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'FAIL' WHEN bool_or(event_type = 'purchase') THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n FROM events GROUP BY user_id",
}


# -- JSON
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound by one in six; else cut short, no object, with another key, without the key, or with a text for a number."""
    case = F.col("event_id") % 6
    body = F.expr("left(props, length(props) - 1)")
    text = F.when(case == 1, body).when(case == 2, "[1, 2]").when(case == 3, F.concat(body, F.lit(', "more": true}'))).when(case == 4, "{}").when(case == 5, '{"k": "seven"}').otherwise(F.col("props"))
    decoded, fault = strict(text, {"k": "bigint"})
    return table(spark, sf_dir, "events").select("event_id", decoded["k"].alias("k"), fault.alias("fault"))


def json_keys_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("event_id") % 3 == 0, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "more": true}'))).otherwise(F.col("props"))
    extra = extra_keys(wide, ["k"])
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.size(extra) > 0).alias("n_extra"), F.count("*").alias("n"))


def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<b>"), "event_type", F.lit(" & "), "props")
    return table(spark, sf_dir, "events").select("event_id", safe_json(text).alias("safe"))


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged by construction: fenced, with a trailing comma, cut short, or sound."""
    body = F.expr("left(props, length(props) - 1)")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    damaged = F.when(F.col("event_id") % 4 == 0, fenced).when(F.col("event_id") % 4 == 1, F.concat(body, F.lit(", }"))).when(F.col("event_id") % 4 == 2, body).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(recovered(damaged), "$.k").cast("long").alias("k"))


QUERIES |= {f.__name__: f for f in (json_strict, json_keys_extra, json_safe, json_recover)}
ORACLES |= {
    "json_strict": """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 1 THEN props[:-2] WHEN 2 THEN '[1, 2]' WHEN 3 THEN props[:-2] || ', "more": true}' WHEN 4 THEN '{}' WHEN 5 THEN '{"k": "seven"}' ELSE props END AS j FROM events),
      f AS (SELECT event_id, CASE WHEN NOT json_valid(j) THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object' WHEN len(list_filter(json_keys(j), lambda x: x <> 'k')) > 0 THEN 'unknown_field'
        WHEN NOT list_contains(json_keys(j), 'k') THEN 'missing_field' WHEN json_type(j, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'wrong_type' END AS fault, j FROM t)
      SELECT event_id, CASE WHEN fault IS NULL THEN CAST(j->>'$.k' AS BIGINT) END AS k, fault FROM f""",
    "json_keys_extra": "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS n_extra, count(*) AS n FROM events GROUP BY event_type",
    "json_safe": """SELECT event_id, replace(replace(replace('<b>' || event_type || ' & ' || props, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026') AS safe FROM events""",
    "json_recover": "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events",
}
