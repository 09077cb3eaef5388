"""Queries of manifests: orders as lessons, of which each line gives a variable, a computation on it and on the line before, and every other one a control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import Manifest, manifest_findings, manifests
from ..shared import Rounds
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _manifest(spark: SparkSession, sf_dir: str) -> Manifest:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("long").alias("q"))
    with Rounds(spark) as rounds:  # all parts are made of these
        lines = rounds.result(lines)
    cases = lines.groupBy("case").agg(F.max("n").alias("last"))
    name = lambda kind, n=F.col("n"): F.concat(F.lit(kind), n.cast("string"))
    text = F.col("q").cast("string")
    before = lines.join(lines.select("case", (F.col("n") + 1).alias("n")), ["case", "n"], "left_semi")
    used = lines.select("case", name("c").alias("id"), name("a").alias("ref")).union(before.select("case", name("c"), name("r", F.col("n") - 1)))
    shown = cases.filter("case % 5 != 0").select("case", F.lit("v").alias("id"), name("r", F.col("last")).alias("ref"))
    controls = lines.filter("n % 2 = 1")
    every = cases.select("case", F.explode(F.array(*map(F.lit, ("e1", "e2", "e3")))).alias("id")).filter("id != 'e3' or case % 11 = 0")
    return Manifest(
        cases=cases,
        variables=lines.select("case", name("a").alias("id"), F.lit("scalar").alias("type")).union(lines.select("case", name("r"), F.when(F.col("q") % 9 == 0, "vector").otherwise("scalar"))),
        initial=lines.filter("q % 10 != 0").select("case", name("a").alias("id"), text.alias("value")),
        controls=controls.select("case", name("k").alias("id"), name("a").alias("variable"), F.when(F.col("q") % 4 == 0, F.concat(text, F.lit(".5"))).otherwise(text).alias("first")),
        effects=controls.select("case", name("k").alias("id"), name("r", F.col("n") + 1).alias("ref")).union(controls.select("case", name("k"), F.lit("v"))),
        computations=lines.select("case", name("c").alias("id"), F.col("n").alias("place"), F.lit("scalar").alias("type")),
        reads=used.union(lines.filter("q % 17 = 0").select("case", name("c"), F.lit("a0"))),
        used=used,
        outputs=lines.select("case", name("c").alias("id"), name("r").alias("ref")),
        visuals=shown.select("case", "id"),
        data=shown,
        explorations=every.withColumn("complete", (F.col("id") != "e2") | (F.col("case") % 7 != 0)),
    )


def manifest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding on orders as lessons."""
    return manifest_findings(_manifest(spark, sf_dir))


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lessons as JSON, as the size and the digest of each."""
    return manifests(_manifest(spark, sf_dir)).select("case", F.length("json").cast("long").alias("size"), F.md5("json").alias("digest"))


QUERIES |= {"manifest_gate": manifest_gate, "manifest_documents": manifest_documents}
_LINES = """
WITH l AS (SELECT l_orderkey AS "case", l_linenumber AS n, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, n - row_number() OVER o AS island, max(n) OVER (PARTITION BY "case") AS last, lag(n) OVER o IS NOT DISTINCT FROM n - 1 AS follows, lead(n) OVER o IS NOT DISTINCT FROM n + 1 AS goes_on FROM l WINDOW o AS (PARTITION BY "case" ORDER BY n)),
s AS (SELECT *, n - min(n) OVER (PARTITION BY "case", island) AS level, max(n) OVER (PARTITION BY "case", island) = last AS leads FROM i),
c AS (SELECT "case", any_value(last) AS last, count(*) FILTER (n % 2 = 1) AS controls FROM s GROUP BY 1)"""
ORACLES["manifest_gate"] = _LINES + """,
p AS (SELECT *, max(level) OVER (PARTITION BY "case" ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT "case", 'FEW_CONTROLS' AS code, NULL::VARCHAR AS target FROM c WHERE controls < 2
UNION ALL SELECT "case", 'NOT_TWO_EXPLORATIONS', NULL FROM c WHERE "case" % 11 = 0 UNION ALL SELECT "case", 'NO_VISUALS', NULL FROM c WHERE "case" % 5 = 0
UNION ALL SELECT "case", 'READS_DIFFER', 'c' || n FROM s WHERE q % 17 = 0 UNION ALL SELECT DISTINCT "case", 'UNRESOLVED_READ', 'a0' FROM s WHERE q % 17 = 0
UNION ALL SELECT "case", 'OUTPUT_TYPE', 'r' || n FROM s WHERE q % 9 = 0 UNION ALL SELECT "case", 'WITHOUT_VALUE', 'a' || n FROM s WHERE q % 10 = 0 UNION ALL SELECT "case", 'UNRESOLVED_READ', 'a' || n FROM s WHERE q % 10 = 0
UNION ALL SELECT "case", 'OUT_OF_ORDER', 'c' || n FROM p WHERE before > level
UNION ALL SELECT "case", 'DEFAULT_DIFFERS', 'a' || n FROM s WHERE n % 2 = 1 AND (q % 4 = 0 OR q % 10 = 0) UNION ALL SELECT "case", 'INCOMPLETE_EXPLORATION', 'e2' FROM c WHERE "case" % 7 = 0
UNION ALL SELECT "case", 'UNKNOWN_EFFECT', 'r' || (n + 1) FROM s WHERE n % 2 = 1 AND NOT goes_on UNION ALL SELECT DISTINCT "case", 'UNKNOWN_EFFECT', 'v' FROM s WHERE n % 2 = 1 AND "case" % 5 = 0
UNION ALL SELECT "case", 'DEAD_CONTROL', 'k' || n FROM s WHERE n % 2 = 1 AND ("case" % 5 = 0 OR NOT leads)
UNION ALL SELECT DISTINCT "case", 'EFFECT_NOT_REACHED', 'v' FROM s WHERE n % 2 = 1 AND "case" % 5 <> 0 AND NOT leads"""
ORACLES["manifest_documents"] = _LINES + """,
j AS (SELECT "case", any_value(last) AS last,
  string_agg('{"id":"k' || n || '","variable":"a' || n || '","first":"' || q || CASE WHEN q % 4 = 0 THEN '.5' ELSE '' END || '","effects":["r' || (n + 1) || '","v"]}', ',' ORDER BY n) FILTER (n % 2 = 1) AS controls,
  string_agg('{"id":"c' || n || '","type":"scalar","reads":[' || CASE WHEN q % 17 = 0 THEN '"a0",' ELSE '' END || '"a' || n || '"' || CASE WHEN follows THEN ',"r' || (n - 1) || '"' ELSE '' END || '],"outputs":["r' || n || '"]}', ',' ORDER BY level, n) AS computations,
  string_agg('"r' || n || '"', ',' ORDER BY n) AS outputs, string_agg('{"id":"a' || n || '","value":"' || q || '"}', ',' ORDER BY n) FILTER (q % 10 <> 0) AS initial FROM s GROUP BY 1),
d AS (SELECT "case", '{' || array_to_string(list_filter([CASE WHEN controls IS NOT NULL THEN '"controls":[' || controls || ']' END, '"computations":[' || computations || ']', '"outputs":[' || outputs || ']',
  CASE WHEN "case" % 5 <> 0 THEN '"visuals":[{"id":"v","data":["r' || last || '"]}]' END, CASE WHEN initial IS NOT NULL THEN '"initial":[' || initial || ']' END], lambda x: x IS NOT NULL), ',') || '}' AS json FROM j)
SELECT "case", length(json) AS size, md5(json) AS digest FROM d"""
