"""Queries of equations and the computations that execute them: parts are cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.equations import Equations, equation_findings
from .check_jobs import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def equation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's equation of its price against the computation linked to it: renamed, with other brackets, commuted, with another constant, unmapped, ambiguous, settled by an alias, and more."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), (F.col("p_partkey") % 14).alias("k"), (F.col("p_size") % 7).cast("string").alias("c"))
    col, lit = F.col, F.lit
    rest = F.concat(lit("x * (y + "), "c", lit(")"))
    equation = F.when(col("k") == 9, F.concat(lit("2t = "), rest)).when(col("k") == 10, F.concat(lit("u = "), rest)).when(col("k") == 11, rest).when(col("k") == 12, lit("x * (y +")).otherwise(F.concat(lit("t = "), rest))
    form = F.when(col("k") == 1, F.concat(lit("(a*(b + "), "c", lit(".0))"))).when(col("k") == 2, F.concat(lit("(b + "), "c", lit(") * a"))).when(col("k") == 3, F.concat(lit("a * (b + 1"), "c", lit(")"))).when(col("k") == 4, F.concat(lit("a * (z + "), "c", lit(")")))
    computed = form.when(col("k") == 8, F.concat(lit("b * (a + "), "c", lit(")"))).otherwise(F.concat(lit("a * (b + "), "c", lit(")")))
    both = lambda *rows: p.select("case", "k", F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in r.items()]) for r in rows])))
    row = lambda **kw: {n: lit(v) if isinstance(v, str) or v is None else v for n, v in kw.items()}
    # in 5 and 6 both variables are written x; in 6 the computation's alias x settles which is meant, in 7 its alias y means the other one
    second = F.when(col("k").isin(5, 6), "x").otherwise("y")
    bindings = both(row(alias="a", variable="v1"), row(alias="b", variable="v2")).select("case", lit("c").alias("id"), "alias", "variable")
    more = p.filter("k = 6").select("case", lit("c"), F.explode(F.array(lit("x"))), lit("v1")).union(p.filter("k = 7").select("case", lit("c"), lit("y"), lit("v1")))
    return equation_findings(Equations(
        computations=p.select("case", lit("c").alias("id"), F.when(col("k") == 13, "machine").otherwise("expression").alias("kind"), computed.alias("expression")),
        bindings=bindings.union(more),
        outputs=p.select("case", lit("c").alias("id"), lit("v0").alias("variable")),
        links=p.select("case", lit("c").alias("id"), lit("q").alias("equation")).union(p.filter("case % 15 = 0").select("case", lit("c"), lit("q9"))),
        equations=p.select("case", lit("q").alias("equation"), equation.alias("expression")).union(p.filter("case % 4 = 0").select("case", lit("q2"), lit("x + y"))),
        equation_variables=both(row(equation="q", variable="v1"), row(equation="q", variable="v2")).select("case", "equation", "variable"),
        variables=both(row(variable="v0", source_symbol="t", display_symbol="total"), row(variable="v1", source_symbol="x", display_symbol=None), row(variable="v2", source_symbol=second, display_symbol="")).select("case", "variable", "source_symbol", "display_symbol"),
        scope=p.filter("case % 8 = 0").select("case", lit("q2").alias("equation"), lit("context_only").alias("scope")).union(p.filter("case % 9 = 0").select("case", lit("q8"), lit("context_only"))),
    ))


QUERIES["equation_links"] = equation_links
ORACLES["equation_links"] = """
WITH p AS (SELECT p_partkey AS "case", p_partkey % 14 AS k, p_size % 7 AS c FROM part)
SELECT "case", CASE k WHEN 2 THEN 'EQUATION_DIFFERS' WHEN 3 THEN 'EQUATION_DIFFERS' WHEN 4 THEN 'SYMBOL_UNMAPPED' WHEN 5 THEN 'SYMBOL_AMBIGUOUS' WHEN 6 THEN 'SYMBOL_UNMAPPED' WHEN 7 THEN 'BINDING_AMBIGUOUS' WHEN 8 THEN 'EQUATION_DIFFERS'
    WHEN 9 THEN 'NOTATION_UNSUPPORTED' WHEN 10 THEN 'OUTPUT_SYMBOL_DIFFERS' WHEN 12 THEN 'EXPRESSION_INVALID' ELSE 'LINK_KIND_UNSUPPORTED' END AS code, 'c:q' AS target,
  CASE k WHEN 2 THEN '(b + ' || c || ') * a' WHEN 3 THEN 'a * (b + 1' || c || ')' WHEN 4 THEN 'z' WHEN 5 THEN 'x' WHEN 6 THEN 'y' WHEN 7 THEN 'y' WHEN 8 THEN 'b * (a + ' || c || ')' WHEN 9 THEN '2t = x * (y + ' || c || ')' WHEN 10 THEN 'u' WHEN 12 THEN 'x * (y +' ELSE 'machine' END AS detail
FROM p WHERE k NOT IN (0, 1, 11)
UNION ALL SELECT "case", 'EQUATION_UNKNOWN', 'c:q9', 'q9' FROM p WHERE "case" % 15 = 0
UNION ALL SELECT "case", 'EQUATION_UNLINKED', 'q2', NULL FROM p WHERE "case" % 4 = 0 AND "case" % 8 <> 0
UNION ALL SELECT "case", 'SCOPE_UNKNOWN', 'q8', NULL FROM p WHERE "case" % 9 = 0
UNION ALL SELECT "case", 'SCOPE_UNKNOWN', 'q2', NULL FROM p WHERE "case" % 8 = 0 AND "case" % 4 <> 0"""
