"""Queries of the grounding and coverage gates: customers are cases, their orders claims, records and computations, and their lines references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.coverage import Coverage, coverage_findings
from ..operators.grounding import Grounding, claim_lineage, grounding_findings
from ..operators.recovery import Limits, evidence_packs
from ..shared import Rounds
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _named(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag").join(orders, "l_orderkey")


def _kept_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``_lines`` as a table, for those that read them often."""
    with Rounds(spark) as rounds:
        return rounds.result(_lines(spark, sf_dir).select("case", "l_orderkey", "l_linenumber", "l_partkey", *columns))


def _grounding(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> Grounding:
    key = F.col("o_orderkey")
    text = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), "o_orderkey", _named("o", "o_orderkey").alias("claim_id"), text.alias("claim"))
    kind = F.when(key % 5 < 2, "SOURCE_GROUNDED").when(key % 5 < 4, "DERIVED").otherwise("PEDAGOGICAL")
    state = F.when(key % 17 == 0, "UNSUPPORTED").when(key % 19 == 0, "PARTIAL").otherwise("SUPPORTED")
    said = F.when(key % 11 == 0, F.concat(F.lit("old "), "claim")).otherwise(F.col("claim"))
    records = own.filter(key % 9 != 0).select("case", (key * 2).alias("record"), "claim_id", said.alias("claim"), kind.alias("class"), state.alias("status"))
    again = own.filter(key % 13 == 0).select("case", key * 2 + 1, "claim_id", "claim", F.lit("DERIVED"), F.lit("SUPPORTED"))
    kept, lines = lines, _lines(spark, sf_dir)
    refs = lambda when, kind, c: (lines if kept is None else kept).filter(when).select("case", (F.col("l_orderkey") * 2).alias("record"), F.lit(kind).alias("kind"), c.alias("ref"))
    part, supplier = _named("p", "l_partkey"), _named("s", "l_suppkey")
    thing = F.when(key % 3 == 0, "PEDAGOGICAL").otherwise("SOURCE_GROUNDED")
    known = lambda when, kind, c: lines.filter(when).select("case", F.lit(kind).alias("kind"), c.alias("ref"))
    cases = own.select("case").distinct()
    declared = F.explode(F.array_compact(F.array(F.lit("SOURCE_GROUNDED"), F.when(F.col("case") % 3 != 0, "DERIVED"), F.when(F.col("case") % 4 != 0, "PEDAGOGICAL"))))
    return Grounding(
        cases=cases,
        claims=own.select("case", "claim_id", F.when(key % 23 == 0, "").otherwise(F.col("claim")).alias("claim")),
        records=records.union(again),
        record_refs=refs("l_linenumber <= 3", "evidence", part).union(refs("l_linenumber >= 4", "computation", supplier)),
        objects=own.filter(key % 2 == 0).select("case", F.col("claim_id").alias("id"), thing.alias("class")),
        object_refs=lines.filter("l_orderkey % 2 = 0 and l_linenumber in (1, 4)").select("case", _named("o", "l_orderkey").alias("id"), part.alias("ref")),
        known=known("l_returnflag != 'R' or l_linenumber > 1", "evidence", part).union(known("l_quantity > 5", "computation", supplier)),
        classes=cases.select("case", declared.alias("class")),
        provenance=lines.filter("l_tax >= 0.08").select("case", part.alias("ref")),
    )


def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding on orders as claims of their customers."""
    return grounding_findings(_grounding(spark, sf_dir)).groupBy("case", "code", "target", "status").agg(F.count(F.lit(1)).alias("n"))


def derived_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much evidence stands behind each derived claim: suppliers as computations rest on the parts that they sold the customer, and on the supplier of half their number."""
    lines = _kept_lines(spark, sf_dir, "l_suppkey")
    parts = lines.select("case", F.lit("computation").alias("kind"), _named("s", "l_suppkey").alias("id"), F.lit("evidence").alias("to_kind"), _named("p", "l_partkey").alias("to"))
    half = F.concat(F.lit("s"), F.floor(F.col("l_suppkey") / 2).cast("string"))
    chain = lines.filter("l_suppkey > 1").select("case", F.lit("computation"), _named("s", "l_suppkey"), F.lit("computation"), half)
    found = claim_lineage(_grounding(spark, sf_dir, lines), parts.union(chain))
    return found.groupBy("case", "claim_id").agg(F.count("ref").alias("n"), F.min("ref").alias("first"))


def _coverage(spark: SparkSession, sf_dir: str) -> Coverage:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), "o_orderkey", "o_totalprice")
    lines = _kept_lines(spark, sf_dir).withColumn("v", F.concat(F.lit("v"), (F.col("l_partkey") % 30).cast("string")))
    of = lambda when, kind: lines.filter(when).select("case", _named(kind, "l_orderkey").alias("id"), F.col("v").alias("ref"))
    before = F.lag("o_orderkey").over(W.partitionBy("case").orderBy("o_orderkey"))
    chain = orders.withColumn("before", before).filter("o_orderkey % 4 = 0 and before is not null").select("case", _named("o", "o_orderkey"), _named("o", "before"))
    kinds = {"learning_objective": ("l", "o_orderkey % 2 = 1"), "mechanism": ("q", "o_orderkey % 3 != 0"), "control": ("k", "o_orderkey % 3 != 1"), "computation": ("o", "o_totalprice > 100000"), "visual": ("w", "o_orderkey % 2 = 0"), "exploration": ("x", "o_orderkey % 5 != 0")}
    listed = lambda rows, field: rows.select("case", F.lit(field).alias("field"), _named(kinds[field][0], "o_orderkey").alias("ref"))
    valid = [listed(orders, f) for f in kinds]
    refs = [listed(orders.filter(when), f) for f, (_, when) in kinds.items()]
    cases = orders.select("case").distinct()
    refs.append(cases.filter("case % 40 = 1").select("case", F.lit("computation"), F.lit("o-1")))
    refs.append(listed(orders.filter("case % 40 = 2 and o_orderkey % 2 = 0"), "visual"))
    wanted = F.format_string("Show editable v%d, v%d and V%d inputs of demand", F.col("case") % 30, F.col("case") % 7, F.col("case") % 11)
    both = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(both(parts[1:]))
    return Coverage(
        cases=cases,
        maps=cases.filter("case % 50 != 0").select("case", F.when(F.col("case") % 51 == 1, "other").otherwise(wanted).alias("focus"), wanted.alias("wanted")),
        refs=both(refs),
        valid=both(valid),
        variables=lines.select("case", F.col("v").alias("id"), F.upper("v").alias("symbol")).distinct(),
        controls=lines.filter("l_linenumber = 1").groupBy("case", _named("k", "l_orderkey").alias("id")).agg(F.min("v").alias("variable")),
        effects=of("l_linenumber = 5", "k"),
        inputs=of("l_linenumber <= 2", "o").union(chain),
        outputs=of("l_linenumber in (3, 4)", "o"),
        data=of("l_linenumber in (4, 6)", "w"),
        involved=of("l_linenumber in (2, 7)", "q"),
        setups=orders.select("case", _named("x", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, _named("k", "o_orderkey")).otherwise("k0").alias("ref")),
    )


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding on customers as lessons: orders compute, the first line is a control, later ones are effects, data and mechanisms."""
    return coverage_findings(_coverage(spark, sf_dir)).groupBy("case", "code", "target").agg(F.count(F.lit(1)).alias("n"))


def recovered_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cases with their line items as the elements of a document: packs of at most 6 blocks, planned again with 14 where a reference or needed prose is missing."""
    found, ranked, elements = recovery_tables(spark, sf_dir)
    packs, report = evidence_packs(elements.select("case").distinct(), ranked, found, elements, RECOVERY)
    return packs.join(report, "case").select("case", "block", "element", "round", "blocks", "missing_references", "missing_context", "limited")


RECOVERY = (Limits(3, 6, 1500), Limits(5, 14, 4000))


def recovery_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What references name, candidates and elements. A section is an order; equations have a number from 0 to 39, of which each case names two."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax").distinct()
    order = W.partitionBy("case").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    kind = F.when(F.col("l_partkey") % 3 == 0, "equation").otherwise("paragraph")
    section = F.floor(F.col("l_orderkey") / 2000).alias("section")
    own = lines.select("case", F.row_number().over(order).cast("long").alias("position"), section, kind.alias("kind"), (F.col("l_tax") < 0.01).alias("noise"), (F.col("l_quantity") * 10).cast("long").alias("size"), "l_extendedprice", (F.col("l_partkey") % 40).alias("number"))
    elements = own.withColumns({"element": F.col("position"), "page": F.when(F.col("position") % 5 > 0, F.floor(F.col("position") / 10))})
    named = [own.filter(F.col("kind") == "equation").filter(F.col("number") == n).select("case", F.lit(k).alias("reference"), F.col("position").alias("element")) for k, n in enumerate((F.col("case") % 40, F.col("case") * 7 % 40))]
    rank = F.row_number().over(W.partitionBy("case").orderBy(F.desc("l_extendedprice"), "position"))
    return named[0].union(named[1]), own.withColumn("rank", rank).select("case", F.col("position").alias("element"), "rank"), elements.select("case", "element", "position", "section", "page", "kind", "noise", "size")


_GROUNDING = """
WITH RECURSIVE l AS (SELECT o_custkey AS "case", lineitem.*, 'p' || l_partkey AS part, 's' || l_suppkey AS supp FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
o AS (SELECT o_custkey AS "case", o_orderkey AS k, 'o' || o_orderkey AS claim_id, o_orderstatus || ' ' || o_orderpriority AS claim FROM orders),
rec AS (SELECT "case", k * 2 AS record, claim_id, CASE WHEN k % 11 = 0 THEN 'old ' || claim ELSE claim END AS claim, CASE WHEN k % 5 < 2 THEN 'SOURCE_GROUNDED' WHEN k % 5 < 4 THEN 'DERIVED' ELSE 'PEDAGOGICAL' END AS class,
    CASE WHEN k % 17 = 0 THEN 'UNSUPPORTED' WHEN k % 19 = 0 THEN 'PARTIAL' ELSE 'SUPPORTED' END AS status FROM o WHERE k % 9 <> 0 UNION ALL SELECT "case", k * 2 + 1, claim_id, claim, 'DERIVED', 'SUPPORTED' FROM o WHERE k % 13 = 0),
ref AS (SELECT DISTINCT "case", l_orderkey * 2 AS record, 'evidence' AS kind, part AS ref FROM l WHERE l_linenumber <= 3 UNION SELECT "case", l_orderkey * 2, 'computation', supp FROM l WHERE l_linenumber >= 4)
"""
QUERIES |= {f.__name__: f for f in (claim_grounding, derived_lineage, coverage_gate, recovered_packs)}
ORACLES |= {
    "claim_grounding": _GROUNDING + """,
    obj AS (SELECT "case", claim_id AS id, CASE WHEN k % 3 = 0 THEN 'PEDAGOGICAL' ELSE 'SOURCE_GROUNDED' END AS class FROM o WHERE k % 2 = 0),
    oref AS (SELECT DISTINCT "case", 'o' || l_orderkey AS id, part AS ref FROM l WHERE l_orderkey % 2 = 0 AND l_linenumber IN (1, 4)),
    ev AS (SELECT DISTINCT "case", part AS ref FROM l WHERE l_returnflag <> 'R' OR l_linenumber > 1), co AS (SELECT DISTINCT "case", supp AS ref FROM l WHERE l_quantity > 5),
    bad AS (SELECT DISTINCT "case", record, kind FROM ref WHERE kind = 'evidence' AND ("case", ref) NOT IN (SELECT ("case", ref) FROM ev) UNION SELECT DISTINCT "case", record, kind FROM ref WHERE kind = 'computation' AND ("case", ref) NOT IN (SELECT ("case", ref) FROM co)),
    prov AS (SELECT "case", bool_or(("case", part) NOT IN (SELECT ("case", ref) FROM ev)) AS bad FROM l WHERE l_tax >= 0.08 GROUP BY 1),
    f AS (
      SELECT "case", 'KNOWLEDGE_CLASS_UNDECLARED' AS code, claim_id AS target, 'FAIL' AS status FROM rec WHERE (class = 'DERIVED' AND "case" % 3 = 0) OR (class = 'PEDAGOGICAL' AND "case" % 4 = 0)
      UNION ALL SELECT "case", CASE kind WHEN 'evidence' THEN 'EVIDENCE_REFERENCE_INVALID' ELSE 'COMPUTATION_REFERENCE_INVALID' END, claim_id, 'FAIL' FROM bad JOIN rec USING ("case", record)
      UNION ALL SELECT "case", 'SOURCE_CLAIM_UNGROUNDED', claim_id, 'FAIL' FROM rec WHERE class = 'SOURCE_GROUNDED' AND record NOT IN (SELECT record FROM ref WHERE kind = 'evidence')
      UNION ALL SELECT "case", 'DERIVED_CLAIM_UNBOUND', claim_id, 'FAIL' FROM rec WHERE class = 'DERIVED' AND record NOT IN (SELECT record FROM ref WHERE kind = 'computation')
      UNION ALL SELECT "case", 'GROUNDING_' || status, claim_id, CASE status WHEN 'PARTIAL' THEN 'WARN' ELSE 'FAIL' END FROM rec WHERE status <> 'SUPPORTED'
      UNION ALL SELECT rec."case", 'KNOWLEDGE_CLASS_MISMATCH', claim_id, 'FAIL' FROM rec JOIN obj ON obj."case" = rec."case" AND id = claim_id WHERE obj.class <> rec.class
      UNION ALL SELECT rec."case", 'EVIDENCE_LINEAGE_MISMATCH', claim_id, 'FAIL' FROM rec JOIN obj ON obj."case" = rec."case" AND id = claim_id WHERE obj.class = 'SOURCE_GROUNDED'
        AND EXISTS (SELECT 1 FROM oref WHERE oref.id = obj.id AND (record, oref.ref) NOT IN (SELECT (record, ref) FROM ref WHERE kind = 'evidence'))
      UNION ALL SELECT DISTINCT "case", 'EVIDENCE_REFERENCE_INVALID', id, 'FAIL' FROM oref WHERE ("case", ref) NOT IN (SELECT ("case", ref) FROM ev)
      UNION ALL SELECT "case", 'SOURCE_OBJECT_UNGROUNDED', id, 'FAIL' FROM obj WHERE class = 'SOURCE_GROUNDED' AND id NOT IN (SELECT id FROM oref)
      UNION ALL SELECT "case", 'CLAIM_UNCLASSIFIED', claim_id, 'FAIL' FROM o WHERE k % 23 <> 0 AND claim IS DISTINCT FROM (SELECT arg_max(rec.claim, record) FROM rec WHERE rec.claim_id = o.claim_id)
      UNION ALL SELECT DISTINCT "case", 'DUPLICATE_CLAIM_ID', NULL, 'FAIL' FROM (SELECT "case" FROM rec GROUP BY "case", claim_id HAVING count(*) > 1)
      UNION ALL SELECT "case", 'PROVENANCE_INVALID', 'science.provenance', 'FAIL' FROM prov WHERE bad
      UNION ALL SELECT DISTINCT "case", 'PROVENANCE_MISSING', 'science.provenance', 'FAIL' FROM o WHERE "case" NOT IN (SELECT "case" FROM prov))
    SELECT "case", code, target, status, count(*) AS n FROM f GROUP BY ALL""",
    "derived_lineage": _GROUNDING + """,
    behind AS (SELECT DISTINCT r."case", claim_id, kind, ref FROM rec r JOIN ref USING ("case", record) WHERE class = 'DERIVED'
      UNION SELECT b."case", claim_id, to_kind, e.to FROM behind b JOIN (SELECT DISTINCT "case", supp AS id, 'evidence' AS to_kind, part AS "to" FROM l UNION SELECT "case", supp, 'computation', 's' || (l_suppkey // 2) FROM l WHERE l_suppkey > 1) e
        ON b.kind = 'computation' AND e."case" = b."case" AND e.id = b.ref)
    SELECT "case", claim_id, count(DISTINCT ref) AS n, min(ref) AS first FROM behind WHERE kind = 'evidence' GROUP BY 1, 2""",
    "coverage_gate": """
    WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS "case", l_orderkey AS k, l_linenumber AS n, 'v' || (l_partkey % 30) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    o AS (SELECT o_custkey AS "case", o_orderkey AS k, o_totalprice AS price, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
    m AS (SELECT DISTINCT "case", "case" % 30 AS a, "case" % 7 AS b, "case" % 11 AS c FROM o WHERE "case" % 50 <> 0),
    valid AS (SELECT "case", f.field, f.p || k AS ref, f.p, k, price FROM o, (VALUES ('learning_objective', 'l'), ('mechanism', 'q'), ('control', 'k'), ('computation', 'o'), ('visual', 'w'), ('exploration', 'x')) f(field, p)),
    refs AS (SELECT "case", field, ref FROM valid WHERE CASE p WHEN 'l' THEN k % 2 = 1 WHEN 'q' THEN k % 3 <> 0 WHEN 'k' THEN k % 3 <> 1 WHEN 'o' THEN price > 100000 WHEN 'w' THEN k % 2 = 0 ELSE k % 5 <> 0 END
      UNION ALL SELECT "case", 'computation', 'o-1' FROM m WHERE "case" % 40 = 1 UNION ALL SELECT "case", 'visual', 'w' || k FROM o WHERE "case" % 40 = 2 AND k % 2 = 0),
    e AS (SELECT DISTINCT "case", v AS a, 'o' || k AS b FROM l WHERE n <= 2 UNION SELECT "case", 'o' || before, 'o' || k FROM o WHERE k % 4 = 0 AND before IS NOT NULL UNION SELECT "case", 'o' || k, v FROM l WHERE n IN (3, 4)),
    ctl AS (SELECT "case", 'k' || k AS id, min(v) AS v FROM l WHERE n = 1 GROUP BY 1, 2),
    down AS (SELECT DISTINCT "case", v AS start, v AS node FROM ctl UNION SELECT d."case", d.start, e.b FROM down d JOIN e ON e."case" = d."case" AND e.a = d.node),
    sel AS (SELECT DISTINCT "case", ref FROM refs WHERE field = 'computation'), made AS (SELECT "case", v AS ref FROM l WHERE n IN (3, 4) AND ("case", 'o' || k) IN (SELECT ("case", ref) FROM sel)),
    taken AS (SELECT * FROM made UNION SELECT "case", v FROM l WHERE n <= 2 AND ("case", 'o' || k) IN (SELECT ("case", ref) FROM sel) UNION SELECT "case", 'o' || before FROM o WHERE k % 4 = 0 AND before IS NOT NULL AND ("case", 'o' || k) IN (SELECT ("case", ref) FROM sel)),
    good AS (SELECT DISTINCT r."case", r.field, r.ref FROM refs r JOIN valid USING ("case", field, ref)),
    f AS (
      SELECT DISTINCT "case", 'MISSING_MAP' AS code, NULL AS target FROM o WHERE "case" % 50 = 0
      UNION ALL SELECT "case", 'FOCUS_CHANGED', 'focus' FROM m WHERE "case" % 51 = 1
      UNION ALL SELECT DISTINCT "case", 'EDITABLE_WITHOUT_CONTROL', 'v' || s FROM (SELECT "case", unnest([a, b, c]) AS s FROM m) WHERE ("case", 'v' || s) NOT IN (SELECT ("case", v) FROM ctl)
      UNION ALL SELECT "case", 'INVALID_REFS', field FROM m CROSS JOIN (VALUES ('learning_objective'), ('mechanism'), ('control'), ('computation'), ('visual'), ('exploration')) t(field)
        WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r."case" = m."case" AND r.field = t.field) OR EXISTS (SELECT 1 FROM refs r WHERE r."case" = m."case" AND r.field = t.field AND (r."case", r.field, r.ref) NOT IN (SELECT ("case", field, ref) FROM valid))
          OR EXISTS (SELECT 1 FROM refs r WHERE r."case" = m."case" AND r.field = t.field GROUP BY r.ref HAVING count(*) > 1)
      UNION ALL SELECT "case", 'CONTROL_UNUSED', id FROM ctl WHERE "case" IN (SELECT "case" FROM m) AND ("case", id) IN (SELECT ("case", ref) FROM refs WHERE field = 'control')
        AND NOT EXISTS (SELECT 1 FROM down d JOIN sel ON sel."case" = d."case" AND sel.ref = d.node WHERE d."case" = ctl."case" AND d.start = ctl.v)
      UNION ALL SELECT "case", 'CONTROL_WITHOUT_EFFECT', id FROM ctl WHERE "case" IN (SELECT "case" FROM m) AND (
        NOT EXISTS (SELECT 1 FROM down d JOIN l ON l."case" = d."case" AND l.v = d.node AND l.n IN (4, 6) WHERE d."case" = ctl."case" AND d.start = ctl.v)
        OR EXISTS (SELECT 1 FROM l WHERE l."case" = ctl."case" AND 'k' || l.k = ctl.id AND l.n = 5 AND NOT EXISTS (SELECT 1 FROM down d WHERE d."case" = ctl."case" AND d.start = ctl.v AND d.node = l.v)))
      UNION ALL SELECT g."case", 'MECHANISM_DISCONNECTED', g.ref FROM good g WHERE g.field = 'mechanism' AND "case" IN (SELECT "case" FROM m) AND NOT EXISTS (SELECT 1 FROM l JOIN taken t ON t."case" = l."case" AND t.ref = l.v WHERE l."case" = g."case" AND 'q' || l.k = g.ref AND l.n IN (2, 7))
      UNION ALL SELECT g."case", 'VISUAL_DISCONNECTED', g.ref FROM good g WHERE g.field = 'visual' AND "case" IN (SELECT "case" FROM m) AND NOT EXISTS (SELECT 1 FROM l JOIN made t ON t."case" = l."case" AND t.ref = l.v WHERE l."case" = g."case" AND 'w' || l.k = g.ref AND l.n IN (4, 6))
      UNION ALL SELECT g."case", 'EXPLORATION_IDLE', g.ref FROM good g WHERE g.field = 'exploration' AND "case" IN (SELECT "case" FROM m) AND ((g."case", CASE WHEN g.ref[2:]::BIGINT % 2 = 0 THEN 'k' || g.ref[2:] ELSE 'k0' END) NOT IN (SELECT ("case", ref) FROM refs WHERE field = 'control')))
    SELECT "case", code, target, count(*) AS n FROM f GROUP BY ALL""",
}
