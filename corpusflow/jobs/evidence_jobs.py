"""Query of the gate between sources and evidence: orders are cases, their lines elements and, most of them, blocks; remainders of part numbers break one rule each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.evidence import Evidence, evidence_findings
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by case and rule."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("element")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, k = F.col("p"), F.col("case")
    kind = F.when(p % 3 == 0, "figure").when(p % 3 == 1, "paragraph").otherwise("equation")
    element = {
        "position": F.col("element").cast("long"), "content": F.when(p % 97 == 0, " ").otherwise(F.concat(F.lit("text "), p.cast("string"))), "page": F.floor(F.col("element") / 4), "section": F.lit("s"), "section_title": F.lit("S"), "kind": kind, "noise": p % 13 == 0,
        "equation_number": F.when(p % 3 == 2, (p % 5).cast("string")), "figure_number": F.lit(None).cast("string"), "table_number": F.lit(None).cast("string"), "bbox": p.cast("string"), "rows": F.when(p % 11 == 0, "[[1]]"),
    }
    elements = lines.withColumns(element)
    blocks = elements.filter("s % 4 != 0").withColumn("place", F.row_number().over(W.partitionBy("case").orderBy("element")) - 1)
    block = {
        "evidence": F.concat(F.lit("E"), F.when(p % 53 == 0, 1).otherwise(F.col("element")).cast("string")), "rank": F.col("place") + (p % 59 == 0).cast("int"), "content": F.when(p % 61 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")),
        "kind": F.when(p % 67 == 0, "table").when(p % 3 == 0, "figure_context").otherwise(F.col("kind")), "equation_number": F.when(p % 71 == 0, "x").otherwise(F.col("equation_number")), "bbox": F.when(p % 73 != 0, F.col("bbox")),
        "rows": F.when(p % 22 == 0, None).when(p % 77 == 11, "[[2]]").otherwise(F.col("rows")), "details_omitted": p % 44 == 0, "structured": F.lit(False), "from_pixels": p % 83 == 0,
    }
    blocks = blocks.withColumns(block)
    sources = blocks.filter("p % 101 != 0").select("case", "place", F.when(p % 89 == 0, 99).otherwise(F.col("element")).alias("element"))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case")).distinct()
    confidence = F.get(F.array(*map(F.lit, ("HIGH", "LOW", "AMBIGUOUS"))), (k % 3).cast("int"))
    packs = cases.select("case", F.when(k % 41 == 0, "other").otherwise("source").alias("source_id"), confidence.alias("confidence"), (k % 20000).alias("size"), (k % 43 == 0).alias("size_limited"), (k % 47 == 0).alias("rerank_insufficient"), F.when(k % 51 == 0, 1).otherwise(0).alias("unresolved"), F.when(k % 37 == 0, 2).otherwise(0).alias("omitted_explicit"), F.when(k % 79 == 0, 1).otherwise(0).alias("omitted_context"))
    return evidence_findings(Evidence(
        documents=cases.select("case", F.lit("source").alias("source_id"), F.when(k % 31 != 0, "title").alias("title")),
        elements=elements,
        warnings=cases.filter(k % 29 == 0).select("case", F.lit("PARSE_X: lost: much").alias("warning")),
        packs=packs,
        blocks=blocks,
        sources=sources,
        named=elements.filter(F.col("element") == k % 7 + 1).select("case", F.lit("figure 3").alias("reference"), "element"),
    ), 5).groupBy("case", "rule", "code", "status").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"))


QUERIES["evidence_rules"] = evidence_rules
ORACLES["evidence_rules"] = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS e, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e) - 1 AS place, 'E' || CASE WHEN p % 53 = 0 THEN 1 ELSE e END AS ev FROM l WHERE s % 4 <> 0),
src AS (SELECT *, p % 89 = 0 AS absent FROM b WHERE p % 101 <> 0), inside AS (SELECT k, e FROM src WHERE NOT absent),
c AS (SELECT DISTINCT o_orderkey AS k FROM orders), n AS (SELECT c.k, count(ev) AS n, count(DISTINCT ev) AS ids FROM c LEFT JOIN b ON b.k = c.k GROUP BY 1),
same AS (SELECT *, p % 61 = 0 AS moved, CASE WHEN p % 11 <> 0 THEN p % 77 = 11 ELSE p % 22 = 0 OR p % 77 = 11 END AS cells FROM src WHERE NOT absent),
ctx AS (SELECT DISTINCT a.k FROM l a JOIN l x ON x.k = a.k AND abs(x.e - a.e) = 1 AND x.e // 4 = a.e // 4 WHERE a.p % 3 <> 1 AND x.p % 3 = 1 AND x.p % 13 <> 0 AND (a.k, a.e) IN (SELECT (k, e) FROM inside) AND (x.k, x.e) NOT IN (SELECT (k, e) FROM inside)),
f AS (
  SELECT k, 'empty_source' AS rule, 'PARSE_FAILED' AS code, 'FAIL' AS status, NULL AS target FROM c WHERE k NOT IN (SELECT k FROM l WHERE p % 97 <> 0)
  UNION ALL SELECT k, 'source_id', 'I', 'FAIL', NULL FROM c WHERE k % 41 = 0 UNION ALL SELECT k, 'empty_pack', 'I', 'FAIL', NULL FROM n WHERE n = 0 UNION ALL SELECT k, 'duplicate_ids', 'I', 'FAIL', NULL FROM n WHERE n <> ids
  UNION ALL SELECT k, 'size_limit', 'I', 'FAIL', NULL FROM n WHERE n > 5 OR k % 20000 > 16000 UNION ALL SELECT k, 'size_limited', 'EVIDENCE_SIZE_LIMITED', 'WARN', NULL FROM c WHERE k % 43 = 0
  UNION ALL SELECT k, 'rerank_insufficient', 'S', 'WARN', NULL FROM c WHERE k % 47 = 0 UNION ALL SELECT k, 'unresolved_references', 'S', 'WARN', NULL FROM c WHERE k % 51 = 0 UNION ALL SELECT k, 'omitted_elements', 'S', 'WARN', NULL FROM c WHERE k % 37 = 0
  UNION ALL SELECT k, 'confidence', 'S', 'WARN', NULL FROM c WHERE k % 3 <> 0 UNION ALL SELECT k, 'no_title', 'SOURCE_METADATA_UNAVAILABLE', 'WARN', NULL FROM c WHERE k % 31 = 0
  UNION ALL SELECT k, 'bare_block', 'I', 'FAIL', ev FROM b WHERE (p % 97 = 0 AND p % 61 <> 0) OR p % 101 = 0 UNION ALL SELECT k, 'rank', 'I', 'FAIL', ev FROM b WHERE p % 59 = 0 UNION ALL SELECT k, 'pixels', 'I', 'FAIL', ev FROM b WHERE p % 83 = 0
  UNION ALL SELECT k, 'absent_source', 'I', 'FAIL', ev FROM src WHERE absent UNION ALL SELECT k, 'differs_from_source', 'I', 'FAIL', ev FROM same WHERE moved
  UNION ALL SELECT k, 'cells_omitted', 'EVIDENCE_TABLE_DATA_OMITTED', 'WARN', ev FROM same WHERE NOT moved AND cells AND p % 44 = 0 UNION ALL SELECT k, 'cells_differ', 'I', 'FAIL', ev FROM same WHERE NOT moved AND cells AND p % 44 <> 0
  UNION ALL SELECT k, 'numbers', 'I', 'FAIL', ev FROM same WHERE p % 71 = 0 UNION ALL SELECT k, 'kind', 'I', 'FAIL', ev FROM same WHERE p % 67 = 0 UNION ALL SELECT k, 'bbox', 'I', 'FAIL', ev FROM same WHERE p % 73 = 0
  UNION ALL SELECT l.k, 'reference_omitted', 'S', 'FAIL', 'figure 3' FROM l JOIN c USING (k) WHERE e = k % 7 + 1 AND (k, e) NOT IN (SELECT (k, e) FROM inside)
  UNION ALL SELECT k, 'context_omitted', 'EVIDENCE_CONTEXT_OMITTED', 'WARN', NULL FROM c WHERE k % 79 = 0 OR k IN (SELECT k FROM ctx) UNION ALL SELECT k, 'extraction', 'PARSE_X', 'WARN', NULL FROM c WHERE k % 29 = 0)
SELECT k AS "case", rule, CASE code WHEN 'I' THEN 'EVIDENCE_PACK_INVALID' WHEN 'S' THEN 'RETRIEVAL_INSUFFICIENT_EVIDENCE' ELSE code END AS code, status, count(*) AS n, min(target) AS first FROM f GROUP BY ALL"""
